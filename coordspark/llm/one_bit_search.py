"""Nearest neighbours by cosine through randomly rotated one-bit codes.

1. Every vector o (scaled to length 1) is turned by one random rotation P of its dimension D; its code keeps the
   signs of P o, packed into 64-bit words. The code stands for the unit vector x with components +-1/sqrt(D).
   Two correction scalars go with it: ``scale`` = 1 / <x, P o>, which makes <x, P q> * scale an unbiased
   estimate of <o, q>, and ``spread`` = sqrt(1 - <x, P o>^2) / <x, P o> / sqrt(D - 1), the estimate's deviation.
   The index is a table of (vec_id, vector, code, scale, spread), written to the shared folder.
2. A query is rotated likewise and its components are rounded to ``bits`` bits; the sum of those that meet a one bit
   of a code is then a few AND and popcount operations on packed words.
3. The index is dealt into slots of about ``block`` vectors, and each query goes to every slot. A task holds one
   slot and streams the queries past it, in tiles. For each query the ``FIRST * k`` best estimates are scored exactly;
   of the other vectors only those whose estimate plus error bound (``bound`` deviations of it and of the
   query's rounding) reaches the k-th score found so are scored too. A window then merges the slots.

No index is fitted to the data, so it needs no training sample and works alike at every size. What a task holds is one
slot, one Arrow batch of queries and one tile of estimates. The scan is exhaustive over codes: work grows with
queries x vectors, at 1/32 of the bits of the vectors.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do
rows with a null vec_id; of rows that repeat a vec_id the one with the smallest vector takes part; vectors of
different dimension don't meet. Equal scores rank by vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import batch, written

#: Pairs of a tile of estimates, and of vectors scored exactly at once.
TILE, EXACT = 1 << 20, 1 << 11
#: Estimates scored first, for each hit wanted; what products of unit vectors may be off by rounding.
FIRST, ROUNDING = 8, 1e-9


def rotation(dim: int) -> np.ndarray:
    """The random rotation of one dimension, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _words(bits: np.ndarray) -> np.ndarray:
    """0/1 rows packed into 64-bit words, padded with zeros."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, scale, spread) of rows of one dimension."""
    dim = v.shape[1]
    turned = _unit(v) @ rotation(dim).T
    own = np.abs(turned).sum(1) / np.sqrt(dim)  # <x, P o>, above 0
    spread = np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(max(1, dim - 1))
    return _words(turned > 0), 1 / own, spread


class Queries:
    """Rotated queries of one dimension, rounded to ``bits`` bits a component."""

    def __init__(self, v: np.ndarray, bits: int = 4) -> None:
        self.dim, turned = v.shape[1], _unit(v) @ rotation(v.shape[1]).T
        low, top = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
        step = np.maximum((top - low) / (2**bits - 1), 1e-300)
        u = np.rint((turned - low) / step).astype(np.uint8)
        self.planes = [_words((u >> j) & 1) for j in range(bits)]
        self.low, self.step = low, step
        rounded = low + step * u
        self.total = rounded.sum(1, keepdims=True)
        self.off = np.linalg.norm(turned - rounded, axis=1, keepdims=True)  # length of what rounding took

    def estimates(self, i: int, j: int, code: np.ndarray, ones: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimated cosine of the queries i to j with every code."""
        met = np.zeros((j - i, len(code)), np.int32)
        for bit, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                met += np.bitwise_count(plane[i:j, None, w] & code[None, :, w]).astype(np.int32) << bit
        sums = self.step[i:j] * met + self.low[i:j] * ones
        return (2 * sums - self.total[i:j]) / np.sqrt(self.dim) * scale


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, products summed from the first component on."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        ab += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    return ab / (np.sqrt(aa) * np.sqrt(bb))


def _dots(q: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The products of pairs (row of q, row of v) of unit vectors; ``r`` ascends."""
    out, ends = np.zeros(len(r)), np.searchsorted(r, np.arange(len(q) + 1))
    for row in np.unique(r):
        for i in range(ends[row], ends[row + 1], EXACT):
            k = min(i + EXACT, ends[row + 1])
            out[i:k] = v[c[i:k]] @ q[row]
    return out


class Slot:
    """The vectors of one slot and one dimension, with their codes."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, code: np.ndarray, scale: np.ndarray, spread: np.ndarray) -> None:
        self.ids, self.v, self.unit, self.code, self.scale, self.spread = ids, v, _unit(v), code, scale, spread
        self.ones = np.bitwise_count(code).sum(1, dtype=np.int64)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, bound: float, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query row, vector row, exact score) of the k best of the slot, tile by tile."""
        asked, unit, size = Queries(q, bits), _unit(q), max(1, TILE // max(1, len(self.ids)))
        for i in range(0, len(q), size):
            j = min(i + size, len(q))
            est = asked.estimates(i, j, self.code, self.ones, self.scale)
            est[qids[i:j, None] == self.ids[None, :]] = -np.inf
            # Some of the best estimates, scored exactly: their k-th score is a limit that a hit has to reach.
            most = min(FIRST * k, est.shape[1])
            first = np.argpartition(est, est.shape[1] - most, axis=1)[:, -most:].reshape(-1)
            rows = np.repeat(np.arange(j - i), most)
            score = np.where(est[rows, first] == -np.inf, -np.inf, _dots(unit[i:j], self.unit, rows, first)).reshape(j - i, most)
            kth = np.partition(score, most - k, axis=1)[:, most - k, None] if most >= k else np.full((j - i, 1), -np.inf)
            reach = est + bound * (self.spread + asked.off[i:j] / np.sqrt(asked.dim) * self.scale)
            r, c = np.nonzero((reach >= kth - ROUNDING) & (est > -np.inf))
            near = _dots(unit[i:j], self.unit, r, c) >= kth[r, 0] - ROUNDING
            r, c = r[near], c[near]
            s = cosines(q[i:j][r], self.v[c])
            o = np.lexsort((self.ids[c], -s, r))
            r, c, s = r[o], c[o], s[o]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            yield r[best] + i, c[best], s[best]


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the dimension of their vectors."""
    dims = np.diff(b["vector"].offsets.to_numpy()) if len(b) else np.zeros(0, int)
    for dim in np.unique(dims):
        yield int(dim), b.take(pa.array(np.flatnonzero(dims == dim)))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, part in _by_dim(b):
            code, scale, spread = encode(_vectors(part["vector"], dim))
            yield batch(vec_id=part["vec_id"], vector=part["vector"], code=pa.array([c.tobytes() for c in code], pa.binary()), scale=scale, spread=spread)


def _scan(k: int, bound: float, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by slot, those of the index first: hold a slot, stream the queries past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, slots = None, [], None
        for b in batches:
            slot = b["slot"].to_numpy()
            for s in np.unique(slot):
                lo, hi = np.searchsorted(slot, [s, s + 1])
                mine = b.slice(lo, hi - lo)
                if s != at:
                    at, index, slots = s, [], None
                n = int(np.searchsorted(mine["asks"].to_numpy(zero_copy_only=False).astype(np.int8), 1))
                if n:
                    index.append(mine.slice(0, n))
                if n == len(mine):
                    continue
                if slots is None:  # the first query: the slot is complete
                    slots = {}
                    for dim, p in _by_dim(pa.Table.from_batches(index).combine_chunks().to_batches()[0]) if index else ():
                        code = np.frombuffer(b"".join(p["code"].to_pylist()), "<u8").reshape(len(p), -1)
                        slots[dim] = Slot(p["vec_id"].to_numpy(), _vectors(p["vector"], dim), code, p["scale"].to_numpy(), p["spread"].to_numpy())
                    index = []
                for dim, p in _by_dim(mine.slice(n)):
                    if dim in slots:
                        qids, q = p["vec_id"].to_numpy(), _vectors(p["vector"], dim)
                        for r, c, score in slots[dim].search(qids, q, k, bound, bits):
                            yield batch(query_id=qids[r], vec_id=slots[dim].ids[c], score=score)

    return run


def usable(vector: Column) -> Column:
    """Neither null, empty nor all zero, and every component a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame) -> DataFrame:
    """The index of ``vectors`` (vec_id, embedding): (vec_id, vector, code, scale, spread), written and read again."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    v = v.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    kind = v.schema["vector"].dataType.simpleString()
    return written(v.mapInArrow(_encode, f"vec_id long, vector {kind}, code binary, scale double, spread double"), "one-bit-index")


def search(index: DataFrame, queries: DataFrame, k: int = 5, bound: float = 3.0, bits: int = 4, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of the index for each of ``queries`` (vec_id, vector)."""
    slots = max(1, -(-index.count() // block))
    dealt = index.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int")).withColumn("asks", F.lit(False))
    asked = queries.select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(True).alias("asks"))
    both = dealt.unionByName(asked, allowMissingColumns=True).repartition("slot").sortWithinPartitions("slot", "asks")
    found = both.select("slot", "asks", "vec_id", "vector", "code", "scale", "spread").mapInArrow(_scan(k, bound, bits), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, **params: float) -> DataFrame:
    """Each row of ``vectors`` whose vec_id ``every`` divides is a query against all the others."""
    index = build_index(vectors)
    return search(index, index.filter(F.col("vec_id") % every == 0), k, **params)
