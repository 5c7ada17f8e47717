"""Length-delimited binary records of token ids, with a separate offset index.

A file is a row of frames, in ascending doc_id order within and between files:

    length   8 bytes   little-endian, of the body
    check    4 bytes   masked CRC-32 of the 8 length bytes
    body               doc_id (8, signed), flags (1: ids take 4 bytes; 2: the doc_id is null),
                       then the ids, little-endian, 2 or 4 bytes each
    check    4 bytes   masked CRC-32 of the body
    mark     1 byte    0x0A

Frames are written by Spark's own file writer (a frame is a row, the mark its row separator), so files
go wherever Spark can write, with its commit protocol: a lost executor leaves no half file behind. The
index is made by reading the files back, every length and checksum verified, and holds a row for each
frame: its file, offset and size. ``read_records`` uses it to fetch any records in any order.

Defined results: null text is empty (its end id alone); null doc_ids come first; repeated doc_ids keep a
frame each; an empty table gives no files and an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coordspark.llm.common import batch, doc_texts, save, text_size
from coordspark.llm.tokens import encoder
from coordspark.session import scratch_path

INDEX = "file string, doc_id long, offset long, size long, nth int, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that the checksum of data that holds checksums stays useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids) and ids.max() > 0xFFFF)
    body = struct.pack("<qB", doc_id or 0, wide + 2 * (doc_id is None)) + ids.astype("<u4" if wide else "<u2").tobytes()
    head = struct.pack("<Q", len(body))
    return head + struct.pack("<I", masked(head)) + body + struct.pack("<I", masked(body))


def parse(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids as uint32, place of the next frame); ValueError if the frame is damaged."""
    if at + 12 > len(data):
        raise ValueError(f"cut off at byte {at}")
    (n,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    if check != masked(data[at : at + 8]) or at + 17 + n > len(data):
        raise ValueError(f"bad length at byte {at}")
    body = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(body) or data[at + 16 + n] != 0x0A:
        raise ValueError(f"bad body at byte {at}")
    doc, flags = struct.unpack_from("<qB", body)
    return None if flags & 2 else doc, np.frombuffer(body, "<u4" if flags & 1 else "<u2", offset=9).astype("<u4"), at + n + 17


def _frames(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], np.uint32)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                yield batch(frame=[frame(d, np.concatenate([x, tail])) for d, x in zip(part["doc_id"].to_pylist(), enc.ids(part["text"].to_pylist()), strict=True)])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            name, data = b["path"][i].as_py(), b["content"][i].as_py()
            at = nth = start = 0
            rows = []
            while at < len(data):
                doc, ids, after = parse(data, at)
                rows.append((name, doc, at, after - at, nth, start, len(ids), zlib.crc32(ids.tobytes())))
                at, nth, start = after, nth + 1, start + len(ids)
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ("file", "doc_id", "offset", "size", "nth", "local_start", "n_tokens", "ids_crc32")
    return batch(**{k: pa.array(c, t) for k, c, t in zip(names, zip(*rows, strict=True), types, strict=True)})


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, file_bytes: int = 16 << 20) -> None:
    """Tokenize every text and write the record files below ``path``; about ``file_bytes`` of text a file."""
    rows = doc_texts(docs)
    _, size = text_size(rows)
    ordered = rows.repartitionByRange(size // file_bytes + 1, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_frames(tokenizer, end_id), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(path)


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Read every file below ``path`` back, verify it, and list its frames."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_index, INDEX)


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, offset, doc_id, ids) of the frames named by ``wanted`` (file, offset), rows of the index in any order."""
    lists = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # one file's records at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data, offsets in zip(b["file"].to_pylist(), b["content"].to_pylist(), b["offsets"].to_pylist(), strict=True):
                got = [parse(data, o) for o in offsets]
                yield batch(file=[name] * len(got), offset=pa.array(offsets, pa.int64()), doc_id=pa.array([d for d, _, _ in got], pa.int64()), ids=pa.array([x.astype(np.int64) for _, x, _ in got], pa.list_(pa.int64())))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")
    return files.join(lists, "file").select("file", "content", "offsets").mapInArrow(run, "file string, offset long, doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as record files with their index, and list what the files hold:
    (doc_id, start, n_tokens, ids_crc32, file, offset, size); ``start`` counts the ids of all frames before."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-records")
    write_records(docs, tokenizer, f"{path}/data", end_id)
    save(index_records(spark, f"{path}/data"), f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    return placed(index)


def placed(index: DataFrame) -> DataFrame:
    """The index with each frame's ``start``. Files are ordered by the doc_ids in them, null first: their names
    needn't sort by number (part-100000 comes before part-99999)."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"))  # a row for each file
    base = files.select("file", (F.sum("n").over(W.orderBy(F.asc_nulls_first("low"), "file")) - F.col("n")).alias("base"))
    return index.join(base, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "size")
