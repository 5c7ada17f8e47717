"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.session import scratch_path


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) and the named columns; anything else that ``docs`` carries is left out,
    so its names can't clash with those an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as Parquet. Its shuffle files go when the write is done, not when the driver next collects
    garbage; they are needed no more, as what is read later is the table."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared folder, through Spark's own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    path = scratch_path(df.sparkSession, name)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Rows, and UTF-8 bytes of their texts."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def in_groups(col: str, groups: int) -> Column:
    """The group, 0 to groups - 1, that an even hash deals a row to."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(col), F.lit(-1))), F.lit(int(groups)))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column one after the other, and each row's offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no chunk at all
        col = pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes (a longer row stands alone): numpy then works in the cache."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pack(a: np.ndarray) -> bytes:
    """A sorted uint64 array as its differences, byte plane by byte plane: what compresses lies together."""
    d = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    n = len(b) // 8
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum(d, dtype=np.uint64)


def batch(**cols: object) -> pa.RecordBatch:
    """A record batch of numpy arrays, Arrow arrays or lists."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))
