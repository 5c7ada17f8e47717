"""Cases in which rows were once lost, overwritten or ranked wrongly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordspark.functions.codec import number_text_sql
from coordspark.operators import changes as chg
from coordspark.operators import codec, ops, points as pts
from coordspark.operators import vectors as vec
from coordspark.plans import derived as dv
from coordspark.session import scratch_path
from coordspark.sources import records as rec
from coordspark.streaming import incremental as inc

SF = "/root/testdata/sf0.001"


def test_null_text_is_a_value_not_a_deletion(spark):
    prev = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "id long, checksum string")
    cur = spark.createDataFrame([(1, None), (2, None), (4, "d"), (5, None)], "id long, checksum string")
    got = {r.id: r.change for r in chg.detect_changes(prev, cur).collect()}
    assert got == {1: "modified", 2: "unchanged", 3: "deleted", 4: "modified", 5: "added"}
    after = chg.apply_changes(prev, cur, chg.detect_changes(prev, cur))
    assert sorted(after.collect(), key=lambda r: r.id) == sorted(cur.collect(), key=lambda r: r.id)


def test_failed_rows_are_not_capped_by_default(spark):
    log = dv.failure_log(spark, SF)
    keys = log.select("model_name", "record_id").distinct().count()
    assert ops.merge_failures(log).count() == keys
    assert ops.merge_failures(log, cap=5).count() == 5


def test_point_ids_do_not_collide(spark):
    rows = [(3, 1), (3, 9_999_999), (3, 10_000_001), (4, 1), (4, 10_000_001), (3, -1), (3, -2), (3, 25_000_000), (4, 0)]
    df = spark.createDataFrame(rows, "model_id int, record_id long")
    ids = [r.id for r in df.select(pts.data_point_id(F.col("model_id"), F.col("record_id")).alias("id")).collect()]
    assert len(set(ids)) == len(rows) and None not in ids
    assert ids[0] == 30_000_001 and ids[1] == 39_999_999


def test_restriction_reasons(spark):
    rows = [(1, "compute_error", "m", ["a"]), (2, "security_restriction", "m", ["b"]),
            (3, "singleton_error", "m", ["c"]), (4, "unknown", "m", ["d"])]
    df = spark.createDataFrame(rows, "error_id int, error_type string, model string, restricted_fields array<string>")
    got = {r.field_name: r.reason for r in ops.restrictions(df).collect()}
    assert got == {"a": "compute_error", "b": "security_restriction", "c": "odoo_error", "d": "unknown"}
    plan = {"m": [{"field_name": f, "prefix": f"1^{i}", "field_type": "char", "model_id": 1, "line_no": i}
                  for i, f in enumerate("abcd")]}
    s = codec.encode_records(spark.createDataFrame([(1,)], "id int"), plan, "m", restrictions=got).first()
    assert s.encoded_string == ("1^0*Restricted_from_API|1^1*Restricted_from_API|1^2*Restricted_odoo_error|"
                                "1^3*Restricted_from_API")


def test_prefix_is_text_not_sql(spark):
    plan = {"m": [{"field_name": "a", "prefix": "1^o'k\\", "field_type": "char", "model_id": 1, "line_no": 1}]}
    row = codec.encode_records(spark.createDataFrame([(1, "x")], "id int, a string"), plan, "m").first()
    assert row.encoded_string == "1^o'k\\*x"


@pytest.mark.parametrize("x,text", [
    (1e-20, "1e-20"), (1e21, "1e+21"), (-1.5e25, "-1.5e+25"), (1.5e-7, "1.5e-7"), (1e20, "100000000000000000000"),
    (0.1, "0.1"), (1e-6, "0.000001"), (123456.789, "123456.789"), (450000.0, "450000"), (0.0, "0"), (12345678.25, "12345678.25"),
])
def test_number_text(spark, x, text):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(F.expr(number_text_sql("x")).alias("t")).first().t == text


def test_zero_and_null_vectors(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "id long, vector array<double>")
    got = [(r.id, r.score) for r in vec.knn_search(p, [1.0, 0.0], k=5, min_score=0.0).collect()]
    assert got == [(2, 1.0), (1, 0.0)]
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    got = [(r.id, r.score) for r in vec.knn_batch(p, q, k=5, min_score=0.0).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.0)]


def test_batch_search_breaks_ties_by_id_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=8)
    rows = [(i, [float(x) for x in (same if i % 2 else rng.normal(size=8))]) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    q = p.select(F.col("id").alias("query_id"), "vector")
    got = vec.knn_batch(p, q, k=3, min_score=0.0, block_bytes=8 * 8 * 7)   # nine blocks
    one = vec.knn_batch(p, q, k=3, min_score=0.0)
    key = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    assert key(got) == key(one)
    tied = {(r.query_id, r.rank): r.id for r in got.collect() if r.query_id % 2}
    assert all(tied[i, 1] == 1 and tied[i, 2] == 3 and tied[i, 3] == 5 for i in range(1, 60, 2))


def test_missing_state_is_empty_but_other_errors_show(spark):
    assert rec.read_state(spark, scratch_path(spark, "none"), "id long").count() == 0
    with pytest.raises(Exception):
        rec.read_state(spark, "nofs://bucket/state", "id long").count()


def test_dedup_keeps_the_last_and_no_late_row_is_lost(spark):
    path = scratch_path(spark, "dedup-in")
    schema = "event_id long, ts timestamp_ntz, v string"
    import datetime as d
    t = d.datetime(2024, 1, 5)
    first = [(1, t, "old"), (1, t, "new"), (2, t, "x")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(path)
    base = scratch_path(spark, "dedup-state")
    inc.stream_dedup(spark, path, "event_id", "ts", base=base)
    late = [(3, t - d.timedelta(days=90), "late"), (2, t, "again")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(path)
    got = {r.event_id: r.v for r in inc.stream_dedup(spark, path, "event_id", "ts", base=base).collect()}
    assert got == {1: "new", 2: "again", 3: "late"}


def test_record_stream_keeps_wide_ids_and_the_last_write(spark):
    path = scratch_path(spark, "rec-in")
    schema = "id long, seq long, name string"
    spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (10_000_001, 3, "w"), (None, 4, "n")], schema) \
        .coalesce(1).write.parquet(path)
    plan = {"m": [{"field_name": "name", "prefix": "3^1", "field_type": "char", "model_id": 3, "line_no": 1}]}
    base = scratch_path(spark, "rec-state")

    def run():
        return inc.stream_records(spark, path, lambda s: codec.encode_records(s, plan, "m", keep=("seq",)),
                                  base=base, seq="seq")

    run()
    spark.createDataFrame([(1, 9, "c"), (2, 10, "z")], schema).coalesce(1).write.mode("append").parquet(path)
    points, failed, runs = run()
    got = {r.record_id: r.encoded_string for r in points.collect()}
    assert got == {1: "3^1*c", 2: "3^1*z", 10_000_001: "3^1*w"}
    assert failed.count() == 1 and runs.count() == 2


def test_token_costs_read_whole_texts(spark):
    df = spark.createDataFrame([("s", "x" * 50_000)], "source string, text string")
    assert ops.token_costs(df, "text", "source").first().tokens == 12_500
    assert ops.token_costs(df, "text", "source", max_chars=30_000).first().tokens == 7_500
