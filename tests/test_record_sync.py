"""Record sync: several batches with repeats, late rows, failures and replays equal a full rebuild."""

import pytest
from pyspark.sql import functions as F

from coordspark.operators import changes as chg
from coordspark.operators import points as pts
from coordspark.streaming.record_sync import RecordSync

COLS = "id long, text string, write_date timestamp_ntz"


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, f"2024-01-01 00:00:{s:02d}") for i, t, s in rows], "id long, text string, w string").select(
        "id", "text", F.col("w").cast("timestamp_ntz").alias("write_date"))


def _sync(spark, **kw):
    def encode(rows):
        return rows.select(F.col("id").alias("record_id"), F.lit("m.a").alias("model_name"), F.lit(10).alias("model_id"),
                           F.col("text").alias("encoded_string"), F.lit(1).alias("field_count"), "write_date")

    def embed(text):
        return F.when(~text.startswith("bad"), F.array(F.length(text).cast("float")))

    return RecordSync(spark, "m.a", encode, embed, **kw)


BATCHES = [
    [(1, "a", 1), (2, "bad b", 1), (3, "c", 2), (None, "no id", 1), (None, "no id", 1)],
    [(1, "newer", 5), (1, "older", 4), (2, "bad still", 5), (4, "d", 6), (4, "d", 6)],
    [(2, "good now", 8), (3, "late", 1), (1, "bad later", 9), (5, "bad e", 9)],
]


def _state(sync, last):
    points = {r["record_id"]: (r["encoded_string"], r["vector"]) for r in sync.read("points", last).collect()}
    failures = sorted((str(r["record_id"]), r["failure_stage"], r["retry_count"]) for r in sync.read("failures", last).collect())
    return points, failures


def test_batches_repeats_failures_and_replay(spark):
    sync = _sync(spark)
    for k, rows in enumerate(BATCHES):
        sync.apply(_rows(spark, rows), k)
    points, failures = _state(sync, 2)
    # 1 keeps the point it had; 3's late row is older than its point; 2 failed twice and is cleared
    assert {k: v[0] for k, v in points.items()} == {1: "newer", 2: "good now", 3: "c", 4: "d"}
    assert points[2][1] == [8.0]
    assert failures == [("1", "embedding", 0), ("5", "embedding", 0), ("None", "encoding", 1)]
    runs = [tuple(r)[:5] for r in sync.runs().orderBy("batch").collect()]
    assert runs == [(0, 5, 2, 3, False), (1, 5, 2, 1, False), (2, 4, 2, 2, False)]
    assert str(sync.mark(2)) == "2024-01-01 00:00:09" and sync.last() == 2
    sync.apply(_rows(spark, BATCHES[2]), 2)   # replayed: the same version again
    assert _state(sync, 2) == (points, failures) and sync.runs().count() == 3


def test_load_goes_on_from_the_mark(spark):
    sync = _sync(spark)
    source = _rows(spark, [(1, "a", 1), (2, "b", 2)])
    sync.load(source, 0)
    sync.load(source, 1)
    assert [r["records_processed"] for r in sync.runs().orderBy("batch").collect()] == [2, 0]
    sync.load(source.union(_rows(spark, [(3, "c", 3)])), 2)
    assert set(_state(sync, 2)[0]) == {1, 2, 3} and str(sync.mark(2)) == "2024-01-01 00:00:03"


def test_stream_equals_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    sync = _sync(spark, base=str(tmp_path / "sync"))
    assert sync.last() == -1
    for rows in BATCHES:   # the files of one batch each, one run of the stream after the other
        _rows(spark, rows).coalesce(1).write.mode("append").parquet(src)
        sync.run_stream(src)
    other = _sync(spark)
    for k, rows in enumerate(BATCHES):
        other.apply(_rows(spark, rows), k)
    assert sync.last() == 2 and _state(sync, 2) == _state(other, 2)


@pytest.mark.parametrize("empty", [True, False])
def test_merge_is_one_join_of_two_exchanges(spark, empty):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", 1)], "id long, x string, seq long")
    new = spark.createDataFrame([(1, "A", 2), (2, "B", 4), (3, None, 9), (4, "D", 1)], "id long, x string, seq long")
    new = new.filter("false") if empty else new
    got = {tuple(r) for r in pts.merge(old, new, order="seq", gone=F.col("x").isNull()).collect()}
    assert got == ({tuple(r) for r in old.collect()} if empty else {(1, "A", 2), (2, "b", 5), (4, "D", 1)})
    assert {tuple(r) for r in pts.upsert(old, new).collect()} == ({tuple(r) for r in old.collect()} if empty else {tuple(r) for r in new.collect()})
    if empty:  # planned away
        return
    plan = pts.merge(old, new, order="seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_merge_snapshots_keeps_what_is_unchanged(spark):
    old = spark.createDataFrame([(1, "x", "v1"), (2, None, "v2"), (3, "z", "v3")], "id long, checksum string, vector string")
    new = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "q", None), (4, "n", None)], "id long, checksum string, vector string")
    got = {tuple(r) for r in chg.merge_snapshots(old, new).collect()}
    assert got == {(1, "x", "v1", "unchanged"), (2, None, "v2", "unchanged"), (3, "q", None, "modified"), (4, "n", None, "added")}


def test_the_runs_over_orders_count_their_lines_once(spark, monkeypatch):
    """each of the three runs read lineitem again and counted the lines of all orders."""
    from coordspark.plans import queries as q

    read, apply = [], q.RecordSync.apply

    def seen(self, rows, batch):
        read.append([f for f in rows.inputFiles() if "lineitem" in f])
        apply(self, rows, batch)

    monkeypatch.setattr(q.RecordSync, "apply", seen)
    assert q._synced_orders(spark, "/root/testdata/sf0.001").last() == 2
    assert read == [[], [], []]
