"""Best-fit decreasing packing with a segment tree over remaining capacities.

Lengths are whole numbers up to ``capacity``, so all pieces of one length are alike and so are all open
bins with the same room. The packing of any number of pieces is therefore fixed by how many pieces
each length has: a summary of ``capacity`` counts. The driver packs that summary, longest first, taking
runs of equal pieces into runs of equal bins; a segment tree over the rooms finds the tightest open bin
in logarithmic time. The result is a bounded list of runs (length, ranks, bins, offset); every piece
finds its place by its rank among the pieces of its length. No piece passes through the driver.

Defined results: a null text is empty (its end id alone); a document longer than ``capacity`` is cut
into full pieces and a rest, no other is cut; rows with equal or null doc_ids are packed each by itself;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coordspark.llm.common import batch, doc_texts, written
from coordspark.llm.tokens import encoder


class TightestRoom:
    """Segment tree over rooms 0 to ``capacity``: which of them have open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += bins
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest room of at least ``least`` with an open bin."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:  # a left child, with open bins to its right
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, offset): piece ``first rank + i`` goes to bin ``first bin + i``."""
    tree, open_bins, plan, bins = TightestRoom(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def leave(room: int, start: int, n: int) -> None:
        if room and n:
            open_bins[room].append((start, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (room := tree.find(length)) is not None:
            start, n = open_bins[room].popleft()
            take = min(n, left)
            tree.add(room, -take)
            if take < n:
                open_bins[room].appendleft((start + take, n - take))
            plan.append((length, rank, take, start, capacity - room))
            rank, left = rank + take, left - take
            leave(room - length, start, take)
        # Open bins have no room for the others: each new bin takes as many as fit before the next is opened.
        each = capacity // length
        full, rest = divmod(left, each)
        for new, held in ((full, each), (int(rest > 0), rest)):
            for k in range(held if new else 0):
                plan.append((length, rank, new, bins, k * length))
                rank += new
            leave(capacity - held * length, bins, new)
            bins += new
    return plan


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], np.uint32)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                out: list[tuple[int | None, int, int, int, int]] = []
                for doc, ids in zip(part["doc_id"].to_pylist(), enc.ids(part["text"].to_pylist()), strict=True):
                    ids = np.concatenate([ids, tail]).astype("<u4")
                    out += [(doc, k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
                yield batch(**{k: pa.array(v, t) for k, v, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    return run


def _placed(plan: list[tuple[int, int, int, int, int]]):
    a = np.array(sorted(plan), np.int64).reshape(-1, 5)
    width = int(a[:, 1:3].sum(1).max(initial=0)) + 1
    key = a[:, 0] * width + a[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b["rank"].to_numpy()
            at = np.searchsorted(key, b["length"].to_numpy() * width + rank, "right") - 1
            own = {c: b[c] for c in b.schema.names if c != "rank"}
            yield batch(**own, sequence_id=a[at, 3] + rank - a[at, 1], offset=a[at, 4])

    return run


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, ranked_rows: int = 250_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    ``ranked_rows``: about so many rows are numbered by one task; beyond that a length's pieces are
    numbered in several groups, one after the other.
    """
    pieces = doc_texts(docs).mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces, "pack-pieces")
    groups = pieces.count() // ranked_rows + 1
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = pieces.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("grp")) - F.col("n")).drop("n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    nth = F.row_number().over(W.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("nth", nth).join(before, ["length", "grp"]).withColumn("rank", F.col("nth") - 1 + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(best_fit_plan(counts, capacity)), f"{schema}, sequence_id long, offset long")
