"""Exact dedup as a Grace hash job: records are partitioned by hash until each bucket fits, then an
open-addressing table per bucket compares whole contents.

1. Every scan task passes its rows through an open-addressing table, so a text goes on once per task
   however many copies it has (a hot text never travels whole with each copy).
2. These records are spilled to a table in the shared folder. Their hash is cut into 6-bit digits;
   a bucket is a prefix of digits. Buckets above ``bucket_bytes`` are split by one more digit, level
   by level, until all fit (or hold one hash value only: at most one record per task).
3. One table per bucket finds the records with equal content. Only (record, keep_id, size, sha256)
   leaves it; each row finds its record's result by a join on the record's own number, so no task
   gathers the rows of a large group.

Defined results: null text counts as empty; the largest doc_id of a group stays (all rows that carry
it, if it is repeated); null doc_ids lose to any other, and if a group has no other, all its rows
stay with a null keep_id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import batch, doc_texts, written

_FANOUT = 64


class OpenTable:
    """Linear probing over a power-of-two array of slots, at most half full. Slots hold entry numbers."""

    def __init__(self, most: int) -> None:
        self.mask = (1 << max(4, (2 * most - 1).bit_length())) - 1
        self.slots = [-1] * (self.mask + 1)
        self.hashes: list[int] = []
        self.contents: list[str] = []

    def entry(self, h: int, content: str) -> int:
        """The number of the entry with this whole content; a new one if there is none."""
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & self.mask
        self.slots[at] = k = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        return k


def _entries(hashes: list[int], contents: list[str]) -> np.ndarray:
    table = OpenTable(len(hashes))
    return np.fromiter(map(table.entry, hashes, contents), np.int64, len(hashes))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row; the first of each content in a batch carries the text, count and largest id."""
    part, nth = TaskContext.get().partitionId(), 0
    for b in batches:
        if not len(b):
            continue
        entry = _entries(b["h"].to_pylist(), b["text"].to_pylist())
        n = int(entry.max()) + 1
        _, first = np.unique(entry, return_index=True)
        ids = b["doc_id"]
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        keep = np.full(n, np.iinfo(np.int64).min)
        np.maximum.at(keep, entry[known], pc.fill_null(ids, 0).to_numpy()[known])
        lead = np.zeros(len(b), bool)
        lead[first] = True
        base = (part << 40) + nth
        nth += n
        mine = keep[entry]
        yield batch(
            doc_id=ids, rid=base + entry, h=b["h"], text=pc.if_else(pa.array(lead), b["text"], pa.scalar(None, pa.string())),
            keep=pa.array(mine, mask=(mine == np.iinfo(np.int64).min) | ~lead), n=pa.array(np.bincount(entry)[entry], mask=~lead),
        )


def _bucket(t: pa.Table) -> pa.Table:
    """The records of one bucket: what each one's group keeps and counts."""
    texts = t["text"].to_pylist()
    entry = _entries(t["h"].to_pylist(), texts)
    low = np.iinfo(np.int64).min
    keep = np.full(int(entry.max()) + 1, low)
    np.maximum.at(keep, entry, pc.fill_null(t["keep"], low).to_numpy())
    size = np.zeros(len(keep), np.int64)
    np.add.at(size, entry, t["n"].to_numpy())
    sha: dict[int, str] = {}
    for e, x in zip(entry.tolist(), texts, strict=True):
        if e not in sha:
            sha[e] = hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    k = keep[entry]
    return pa.table({"rid": t["rid"], "keep_id": pa.array(k, mask=k == low), "group_size": size[entry], "text_sha256": [sha[e] for e in entry.tolist()]})


def _split(spill: DataFrame, bucket_bytes: int) -> DataFrame:
    """Give each spilled record its bucket: the shortest suffix of hash digits whose records fit.

    What is collected is the list of buckets above the limit, at most bytes / ``bucket_bytes`` a level.
    """
    recs = spill.filter("text IS NOT NULL")
    left = recs.select("h", F.octet_length("text").alias("b"))
    digits = [F.pmod(F.col("h"), F.lit(_FANOUT ** (d + 1))) for d in range(9)]
    bucket, split = F.struct(F.lit(0).alias("depth"), digits[0].alias("digits")), F.lit(True)
    for d in range(8):
        sizes = left.groupBy(digits[d].alias("p")).agg(F.sum("b").alias("b"), (F.min("h") != F.max("h")).alias("many"))
        big = [r["p"] for r in sizes.filter((F.col("b") > bucket_bytes) & F.col("many")).collect()]
        if not big:
            break
        left, split = left.filter(digits[d].isin(big)), split & digits[d].isin(big)
        bucket = F.when(split, F.struct(F.lit(d + 1).alias("depth"), digits[d + 1].alias("digits"))).otherwise(bucket)
    return recs.withColumn("bucket", bucket)


def grace_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    ``normalise`` maps the text column before it is compared (default: no change).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = doc_texts(docs).withColumn("text", normalise(text) if normalise else text).withColumn("h", F.xxhash64("text"))
    spill = written(rows.mapInArrow(_local, "doc_id long, rid long, h long, text string, keep long, n long"), "grace-spill")
    found = _split(spill, bucket_bytes).groupBy("bucket").applyInArrow(_bucket, "rid long, keep_id long, group_size long, text_sha256 string")
    return (
        spill.select("doc_id", "rid").join(found, "rid")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
