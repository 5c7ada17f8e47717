"""Structured Streaming forms of the incremental operators.

* I5 usage counters: a streaming ``groupBy().agg()`` in ``update`` mode keeps
  a row per catalog field in the state store (checkpointed, so it survives
  executor loss and restarts); each micro-batch's updated keys are appended to
  a Parquet delta table partitioned by epoch. The current
  table is "latest epoch per key" - a ``max_by`` aggregate over the deltas.
  Writing an epoch overwrites only that epoch's partition, so a replayed
  epoch is idempotent.
* I2 record pipeline: stream records -> encode -> embed -> ``foreachBatch``
  writes the batch's points as an epoch partition (last write per id wins
  when read, K1/I7) and routes rows that fail a quality check to the failed
  rows log (K5 input).
* I6 failed rows and I7 duplicate suppression: their keys have no bound, so they
  are kept as versions of a keyed table outside the state store; no late row
  is lost and the stream holds no state.

All paths live under the session's shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.records import read_state


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet file source with the schema of the existing files (no inference at runtime).

    A path naming one file streams its folder restricted to that file name
    (``pathGlobFilter``); new files land in a folder in practice.
    """
    import os

    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet"):
        folder, name = os.path.split(path.rstrip("/"))
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  output_mode: str = "update") -> None:
    """Process everything available now (``availableNow`` trigger) and stop."""
    q = (df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def epoch_delta_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: write the batch as partition ``epoch=<id>`` (overwrite = replay-safe)."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(int(epoch_id)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(path))
    return sink


def latest_per_key(spark: SparkSession, path: str, key: list[str],
                   base: tuple[str, int] | None = None, order: list[str] | None = None) -> DataFrame:
    """Current table from an epoch delta table: the newest epoch's row per key;
    within an epoch the row that is last by the columns ``order``.

    With ``base = (base_path, base_epoch)`` from ``compact_deltas`` only the
    epochs after the base are read (partition pruning on ``epoch``) and
    merged with the compacted base.
    """
    d = spark.read.parquet(path)
    if base is not None:
        d = d.filter(F.col("epoch") > F.lit(base[1]))
        b = spark.read.parquet(base[0]).withColumn("epoch", F.lit(base[1]).cast(d.schema["epoch"].dataType))
        d = b.unionByName(d.select(*b.columns))
    vals = [c for c in d.columns if c not in key and c != "epoch"]
    return (d.groupBy(*key).agg(F.max_by(F.struct(*vals), F.struct("epoch", *(order or []))).alias("r"))
            .select(*key, "r.*"))


def compact_deltas(spark: SparkSession, path: str, key: list[str],
                   base: tuple[str, int] | None = None) -> tuple[str, int]:
    """Write "latest per key" up to the newest epoch as a new base version
    (a fresh path; nothing being read is overwritten). Returns (base_path,
    base_epoch) for later reads; older delta partitions are no longer read."""
    top = spark.read.parquet(path).agg(F.max("epoch")).collect()[0][0]
    if top is None:
        return base if base is not None else (path, -1)
    cur = latest_per_key(spark, path, key, base).drop("epoch")
    out = scratch_path(spark, "compacted")
    cur.write.mode("overwrite").parquet(out)
    return out, int(top)


def stream_usage_counts(spark: SparkSession, events_path: str, to_usage: Callable[[DataFrame], DataFrame],
                        base: str | None = None, max_files: int | None = None) -> DataFrame:
    """Running usage counters per (model, field), batch-equal to ``ops.usage_counts``."""
    from ..operators.ops import usage_counts

    base = base or scratch_path(spark, "usage-stream")
    agg = usage_counts(to_usage(file_stream(spark, events_path, max_files)))
    run_available(agg, epoch_delta_sink(base + "/delta"), base + "/checkpoint")
    return latest_per_key(spark, base + "/delta", ["model_name", "field_name"])


def keyed_versions(spark: SparkSession, path: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """A keyed table kept outside the state store, so the stream itself holds no state.

    Returns the ``foreachBatch`` sink and a reader of the newest version (None
    before the first). A micro-batch writes the version of its number as ``fold``
    of the version before and itself; a replayed one overwrites its own. The
    table is as large as its keys, however long the stream runs.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/version-{epoch - 1}") if epoch else None
        fold(before, batch).write.mode("overwrite").parquet(f"{path}/version-{epoch}")
        batch.sparkSession.createDataFrame([(epoch,)], "epoch long").write.mode("append").parquet(f"{path}/epochs")

    def read() -> DataFrame | None:
        epochs = read_state(spark, f"{path}/epochs", "epoch long")
        last = epochs.agg(F.max("epoch")).first()[0]
        return None if last is None else spark.read.parquet(f"{path}/version-{last}")

    return sink, read


def fold_failures(before: DataFrame | None, log: DataFrame) -> DataFrame:
    """Failed rows per key: newest event, events so far, first and last sequence. Batch and table are
    aggregated alike, so a key with many failures is one row before the shuffle."""
    newest = F.struct("model_id", "failure_stage", "error_message", "batch_number", "encoded_string", "failed_at")
    part = (log.groupBy("model_name", "record_id")
            .agg(F.max_by(newest, F.col("seq")).alias("r"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"),
                 F.max("seq").alias("last_seq")))
    if before is None:
        return part
    return (before.unionByName(part).groupBy("model_name", "record_id")
            .agg(F.max_by("r", "last_seq").alias("r"), F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"),
                 F.max("last_seq").alias("last_seq")))


def stream_failed_rows(spark: SparkSession, source_path: str, to_failures: Callable[[DataFrame], DataFrame],
                       base: str | None = None, cap: int | None = None, max_files: int | None = None) -> DataFrame:
    """Failed rows by key (newest event, retry count) from a failure stream, equal to the batch
    form; no state in the stream (all keys; ``cap`` keeps the newest ones by first failure)."""
    base = base or scratch_path(spark, "dlq-stream")
    sink, read = keyed_versions(spark, base + "/failures", fold_failures)
    log = to_failures(file_stream(spark, source_path, max_files))
    run_available(log, sink, base + "/checkpoint", output_mode="append")
    cur = read()
    cur = fold_failures(None, spark.createDataFrame([], log.schema)) if cur is None else cur
    cur = cur.select("model_name", "record_id", "r.*", (F.col("n") - 1).alias("retry_count"), "first_seq")
    if cap:
        cur = cur.orderBy(F.desc("first_seq"), "model_name", "record_id").limit(cap)
    return cur


def stream_dedup(spark: SparkSession, path: str, key: str, ts_col: str, base: str | None = None,
                 max_files: int | None = None) -> DataFrame:
    """One row per key, the last one written: by micro-batch, then ``ts_col``,
    then place in the batch. Rows that come late count like any other. A read
    is a scan of one row per key, not of all that was ever written."""
    from ..operators.points import merge

    base = base or scratch_path(spark, "dedup-stream")
    s = file_stream(spark, path, max_files)

    def fold(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c != key]
        placed = batch.withColumn("_place", F.monotonically_increasing_id())
        last = F.max_by(F.struct(*rest), F.struct(ts_col, "_place")).alias("_row")
        return merge(before, placed.groupBy(key).agg(last).select(key, "_row.*").select(*batch.columns), key)

    sink, read = keyed_versions(spark, base + "/rows", fold)
    run_available(s, sink, base + "/checkpoint", output_mode="append")
    cur = read()
    return spark.createDataFrame([], s.schema) if cur is None else cur.select(*s.columns)


def stream_records(spark: SparkSession, source_path: str, encode: Callable[[DataFrame], DataFrame],
                   embed: Callable[[DataFrame], DataFrame] | None = None,
                   base: str | None = None, max_files: int | None = None,
                   seq: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I2 + I9: records -> encode -> embed -> points (epoch deltas) and failed rows.

    A record fails the quality check when it has no point id (a NULL record
    id, E10). Of repeated records the last one written stays: by micro-batch,
    then by the column ``seq`` (a sequence or change time that ``encode``
    carries through, if named), then place in the batch. Returns (points,
    failed rows, run log) read back from the sinks; per-batch counts come
    from ``observe`` on the batch frame.
    """
    from ..operators.points import data_point_id, data_points

    base = base or scratch_path(spark, "records-stream")
    enc = encode(file_stream(spark, source_path, max_files))
    order = [*([seq] if seq else []), "_place"]
    pts_path, dlq_path, runs_path = base + "/points", base + "/failed", base + "/runs"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        import time

        from pyspark.sql import Observation

        from ..operators.common import spread

        t0 = time.time()
        bad = data_point_id(F.col("model_id"), F.col("record_id")).isNull()
        batch = spread(batch.withColumn("_place", F.monotonically_increasing_id())).persist()
        obs = Observation(f"run_{epoch_id}")
        pts = data_points(batch.observe(obs, F.count(F.lit(1)).alias("processed"),
                                        F.count_if(~bad).alias("embedded")).filter(~bad),
                          sync_ts=F.current_timestamp(), keep=tuple(order))
        if embed is not None:
            pts = embed(pts.drop("vector"))
        epoch_delta_sink(pts_path)(pts, epoch_id)
        failed = batch.filter(bad).select(
            "record_id", "model_name", "model_id", F.lit("encoding").alias("failure_stage"),
            F.lit("record without a point id").alias("error_message"),
            F.lit(int(epoch_id)).cast("int").alias("batch_number"), "encoded_string",
            F.current_timestamp().alias("failed_at"))
        epoch_delta_sink(dlq_path)(failed, epoch_id)
        batch.unpersist()
        m = obs.get
        run = [(int(epoch_id), int(m.get("processed", 0)), int(m.get("embedded", 0)),
                int(m.get("processed", 0)) == int(m.get("embedded", 0)), int((time.time() - t0) * 1000))]
        (spark.createDataFrame(run, "epoch long, records_processed long, records_embedded long, "
                                    "success boolean, duration_ms long")
         .withColumn("ts", F.current_timestamp())
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch")
         .parquet(runs_path))

    run_available(enc, sink, base + "/checkpoint", output_mode="append")
    points = latest_per_key(spark, pts_path, ["id"], order=order).drop(*order)
    failed = spark.read.schema(
        "record_id long, model_name string, model_id int, failure_stage string, error_message string, "
        "batch_number int, encoded_string string, failed_at timestamp, epoch long").parquet(dlq_path).drop("epoch")
    runs = spark.read.parquet(runs_path)
    return points, failed, runs
