"""Record sync as one plan (I2 + J7 + K1 + K5 + K6 + K4 + I9 + W5).

One body takes a batch of source rows, from an incremental load or a
micro-batch: encode, keep the newest row of each record, embed, split good
from failed rows once, merge the good ones into the points by (model,
record) with a sequence, merge and clear the failed rows, advance the
high-water mark, write a run row.

Every batch has a number, and writes the version of that number from the
version before it. A batch that is replayed after a lost driver overwrites its
own version from the same input, so nothing is counted twice. A version is a
whole table (one full outer join, two exchanges), so batches should be large;
dropping old versions is up to the owner of the folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as chg
from ..operators import ops
from ..operators import points as pts
from ..session import scratch_path
from .incremental import file_stream, run_available

RUN_COLUMNS = "batch long, records_processed long, records_embedded long, records_failed long, success boolean, duration_ms long"


class RecordSync:
    """Sync of the records of one model into versions of a point table below ``base``.

    ``encode`` gives E1's columns and the source's change time ``ts_col``;
    ``embed`` the vector of an encoded string as a column (NULL: no vector,
    the row fails at stage embedding). A record without a point id fails at
    stage encoding. Of several rows of a record the one with the latest change
    time stays, then the one with the greatest encoded string; an older row
    that comes later doesn't replace a newer point. A record that fails keeps
    the point it had.
    """

    def __init__(self, spark: SparkSession, model: str, encode: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column],
                 ts_col: str = "write_date", base: str | None = None) -> None:
        self.spark, self.model, self.encode, self.embed, self.ts_col = spark, model, encode, embed, ts_col
        self.base = base or scratch_path(spark, f"sync-{model}")

    def _path(self, table: str, batch: int) -> str:
        return f"{self.base}/{table}/batch-{batch}"

    def read(self, table: str, batch: int) -> DataFrame | None:
        """points, failures or mark as of a batch; None before the first."""
        if batch < 0:
            return None
        return self.spark.read.parquet(self._path(table, batch))

    def runs(self) -> DataFrame:
        """One row per batch."""
        return self.spark.read.schema(RUN_COLUMNS).parquet(f"{self.base}/runs/*")

    def mark(self, batch: int):
        """The high-water mark after a batch (None: nothing loaded yet)."""
        state = self.read("mark", batch)
        return state.first()["last_max_write_date"] if state is not None else None

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Take in one batch; usable as a ``foreachBatch`` body."""
        t0 = time.time()
        seen = Observation(f"rows-{batch}")
        enc = self.encode(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max(self.ts_col).alias("top")))
        # records without a point id can't be told apart: each fails on its own
        lone = F.when(pts.data_point_id(F.col("model_id"), F.col("record_id")).isNull(), F.monotonically_increasing_id())
        newest = F.max_by(F.struct("model_id", "encoded_string", "field_count", F.col(self.ts_col).alias("seq")),
                          F.struct(F.col(self.ts_col), F.col("encoded_string")))
        enc = (enc.withColumn("_lone", lone).groupBy("model_name", "record_id", "_lone").agg(newest.alias("r"))
               .select("model_name", "record_id", "r.*"))
        made = pts.data_points(enc, keep=("seq",)).drop("vector").withColumn("vector", self.embed(F.col("encoded_string")))
        stage = F.when(F.col("id").isNull(), F.lit("encoding")).when(F.col("vector").isNull(), F.lit("embedding"))
        made.withColumn("failure_stage", stage).write.mode("overwrite").parquet(self._path("checked", batch))
        # from here on both sides read what was written: encoded and embedded once
        checked = self.spark.read.parquet(self._path("checked", batch))
        good = checked.filter(F.col("failure_stage").isNull()).drop("failure_stage")
        self._write(pts.merge(self.read("points", batch - 1), good, order="seq"), "points", batch)
        log = checked.filter(F.col("failure_stage").isNotNull()).select(
            "record_id", "model_name", "model_id", "failure_stage",
            F.when(F.col("failure_stage") == "encoding", F.lit("record without a point id")).otherwise(F.lit("no vector")).alias("error_message"),
            F.lit(batch).cast("int").alias("batch_number"), "encoded_string", F.col("seq").alias("failed_at"),
            F.lit(batch).cast("long").alias("seq"))
        failures = ops.merge_failures(log, self.read("failures", batch - 1))
        self._write(ops.remove_failures(failures, good), "failures", batch)
        stats = self.spark.createDataFrame([(seen.get["n"], seen.get["top"])], f"records_loaded long, max_change_time {dict(rows.dtypes)[self.ts_col]}")
        self._write(chg.merge_state(self.read("mark", batch - 1), stats, self.model), "mark", batch)
        n = checked.agg(F.count_if(F.col("failure_stage").isNull()).alias("good"), F.count("failure_stage").alias("bad")).first()
        run = [(batch, seen.get["n"], n["good"], n["bad"], n["bad"] == 0, int((time.time() - t0) * 1000))]
        self._write(self.spark.createDataFrame(run, RUN_COLUMNS), "runs", batch)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch))

    def load(self, records: DataFrame, batch: int, force_full: bool = False) -> None:
        """Take in the rows changed after the mark (all of them at first, or when forced)."""
        self.apply(chg.incremental_rows(records, self.mark(batch - 1), self.ts_col, force_full), batch)

    def run_stream(self, path: str, max_files: int | None = None) -> None:
        """Take in the new files of a folder, a micro-batch at a time."""
        run_available(file_stream(self.spark, path, max_files), self.apply, self.base + "/checkpoint", output_mode="append")

    def last(self) -> int:
        """The number of the last batch, -1 if there is none."""
        try:
            return self.runs().agg(F.max("batch")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
