"""Streaming = batch, replay safety, and the incremental catalog load."""

from pyspark.sql import functions as F

from coordspark.operators import ops, sync
from coordspark.operators import vectors as vec
from coordspark.plans import derived as dv
from coordspark.plans import fixture as fx
from coordspark.session import scratch_path, table_path
from coordspark.streaming import incremental as inc

SF = "/root/testdata/sf0.001"


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_usage_equals_batch(spark):
    s = inc.stream_usage_counts(spark, table_path(SF, "events"), dv.usage_from_events)
    b = ops.usage_counts(dv.usage_log(spark, SF))
    assert _same(s.select(*b.columns), b)


def test_stream_restart_is_idempotent(spark):
    base = scratch_path(spark, "usage-restart")
    first = inc.stream_usage_counts(spark, table_path(SF, "events"), dv.usage_from_events, base=base)
    n = first.count()
    again = inc.stream_usage_counts(spark, table_path(SF, "events"), dv.usage_from_events, base=base)
    assert again.count() == n and _same(first, again)   # no new files: nothing reprocessed


def test_stream_failed_rows_equal_batch(spark):
    s = inc.stream_failed_rows(spark, table_path(SF, "events"), dv.failures_from_events)
    b = ops.merge_failures(dv.failure_log(spark, SF).filter("model_name = 'events'"), cap=None)
    cols = ["model_name", "record_id", "retry_count", "failure_stage", "first_seq"]
    assert _same(s.select(cols), b.select(cols))


def test_stream_records_points_and_run_log(spark):
    from coordspark.operators import catalog as cat, codec

    emap = codec.encoding_plan(cat.encoding_map(fx.catalog(spark, SF)))
    points, failed, runs = inc.stream_records(
        spark, table_path(SF, "customer"),
        lambda s: codec.encode_records(s.withColumnRenamed("c_custkey", "id"), emap, "customer"))
    n = spark.read.parquet(table_path(SF, "customer")).count()
    assert points.count() == n and failed.count() == 0
    r = runs.agg(F.sum("records_processed"), F.sum("records_embedded")).first()
    assert r[0] == n and r[1] == n


def test_incremental_catalog_equals_full(spark):
    def embed(df):
        return vec.hashing_embed(df, "semantic_text", dim=16)

    c = fx.catalog(spark, SF)
    old = c.filter(F.col("model_name") != "labels")
    previous = sync.full_catalog_load(old, embed)
    res = sync.incremental_catalog_load(c, previous, embed)
    full = sync.full_catalog_load(c, embed)
    cols = ["id", "semantic_text", "vector"]
    assert not res.skipped and _same(res.points.select(cols), full.select(cols))
    assert res.summary.first().added == c.filter("model_name = 'labels'").count()
    again = sync.incremental_catalog_load(c, full, embed)
    assert again.skipped and again.summary.first().summary == "No changes detected"


def test_compacted_read_equals_full_read(spark):
    base = scratch_path(spark, "usage-compact")
    path = base + "/delta"
    ev = spark.read.parquet(table_path(SF, "events"))
    key = ["model_name", "field_name"]
    sink = inc.epoch_delta_sink(path)
    # three epochs of running counts, as update-mode batches would write them
    for epoch, cut in enumerate([200, 500, 10**9]):
        sink(ops.usage_counts(dv.usage_from_events(ev.filter(F.col("event_id") < cut))), epoch)
        if epoch == 1:
            compacted = inc.compact_deltas(spark, path, key)
    full = inc.latest_per_key(spark, path, key)
    fast = inc.latest_per_key(spark, path, key, compacted)
    assert compacted[1] == 1
    assert _same(full, fast.select(*full.columns))


def test_failed_rows_over_many_batches_hold_no_state(spark, tmp_path):
    """Twelve micro-batches with keys that come again: equal to the batch form, and the stream
    keeps nothing in the state store."""
    import os

    from coordspark.operators import ops
    from coordspark.streaming import incremental as inc

    src, base = str(tmp_path / "src"), str(tmp_path / "base")
    schema = ("record_id long, model_name string, model_id int, failure_stage string, error_message string, "
              "batch_number int, encoded_string string, failed_at timestamp_ntz, seq long")
    import datetime as dt
    rows = [(i % 7, "m", 1, "embedding", f"e{i}", i // 5, "", dt.datetime(2024, 1, 1) + dt.timedelta(days=60 - i), i) for i in range(60)]
    for k in range(12):
        spark.createDataFrame(rows[5 * k:5 * k + 5], schema).coalesce(1).write.mode("append").parquet(src)
        if k % 4 == 3:   # three runs of the stream, a file to a micro-batch
            got = inc.stream_failed_rows(spark, src, lambda df: df, base=base, max_files=1)
    key = lambda df: sorted(tuple(r[c] for c in ("record_id", "error_message", "retry_count", "first_seq")) for r in df.collect())
    assert key(got) == key(ops.merge_failures(spark.createDataFrame(rows, schema)))
    assert not os.path.exists(base + "/checkpoint/state")
    again = inc.stream_failed_rows(spark, src, lambda df: df, base=base)   # nothing new
    assert key(again) == key(got)
