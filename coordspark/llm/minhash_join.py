"""Near-duplicates by an inverted join on signature coordinates.

1. Every document gets a signature of ``coords`` minimum hashes of its distinct word shingles. Documents
   with equal shingle sets (exact copies too) form a class; from here on one representative stands for it.
2. Representatives are posted under each (coordinate, value) pair. Two documents must agree in at least
   ``matches`` coordinates to be compared: at the similarity limit of 0.75 a pair agrees in
   48 of 64 coordinates on average and in fewer than 30 with a probability of 4e-7. Postings with
   one document match nothing. Of a document's other ``m`` postings only the m - matches + 1 rarest
   are kept (prefix): two documents that share ``matches`` postings share one of those.
3. Rounds: in each posting list every member is paired with one pivot, not with all others; pairs that agree
   in enough coordinates are confirmed on their full shingle sets, and confirmed links give components.
   Lists whose members all lie in one component are skipped from then on, as they can't join anything.
4. What is left when ``rounds`` are over, lists with members of different components, is merged
   completely. Hot lists have much the same members, so a member is at home in the longest of its lists: first
   each list's own members are compared, then in every list those with different homes, as members
   with one home are done. Lists are cut into blocks of ``block`` bytes of sets, and each pair of blocks is
   compared by a task on the full sets, all pairs of the two blocks by matrix products; what leaves the
   task is at most one link for each member, those that join components. So no such link is lost, no list
   is held by one task, and the pairs of a group are never written out.

Defined results: a null or empty text, or one of white space alone, has no shingle, is linked with
nothing and is its own component; equal rows with one doc_id are one member of a class; null
doc_ids have no component (null) and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coordspark.llm.common import batch, blocks, doc_texts, utf8, written
from coordspark.llm.components import components
from coordspark.llm.words import mix, shingles

def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def signatures(row: np.ndarray, h: np.ndarray, n: int, coords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, two order-free hashes, signature) of each of ``n`` sets given as sorted (row, hash)."""
    size = np.bincount(row, minlength=n)
    sig = np.zeros((n, coords), np.uint32)
    some = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[some]
    sums = np.zeros((2, n), np.uint64)
    if len(some):
        for k, v in enumerate((mix(h + np.uint64(1)), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
            sums[k, some] = np.add.reduceat(v, at)
        mul = np.random.default_rng(64).integers(0, 2**63, (2, coords), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for k in range(coords):
            v = h * mul[0, k]
            v ^= v >> np.uint64(32)
            v *= mul[1, k]
            sig[some, k] = (np.minimum.reduceat(v, at) >> np.uint64(32)).astype(np.uint32)
    return size, sums[0], sums[1], sig


def _sign(size: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b["text"])
            for i, j in blocks(off):
                row, h = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                n, s0, s1, sig = signatures(row, h, j - i, coords)
                yield batch(doc_id=b["doc_id"].slice(i, j - i), n_shingles=n.astype(np.int64), s0=_signed(s0), s1=_signed(s1), sig=_binary(sig))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b["text"])
            for i, j in blocks(off):
                row, h = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                at = np.searchsorted(row, np.arange(j - i + 1))
                yield batch(id=b["doc_id"].slice(i, j - i), n=np.diff(at), set=pa.array([h[at[k] : at[k + 1]].astype("<u8").tobytes() for k in range(j - i)], pa.binary()))

    return run


def _agree(least: int):
    """Keep pairs whose signatures agree in at least ``least`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(utf8(b[c])[0], np.uint32).reshape(len(b), -1) for c in ("sa", "sb"))
                ok = pa.array((x == y).sum(1) >= least)
                yield batch(a=b["a"].filter(ok), b=b["b"].filter(ok))

    return run


def _similar(percent: int):
    """Keep pairs whose full sets have at least ``percent`` hundredths of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (xd, xo), (yd, yo) = utf8(b["xa"]), utf8(b["xb"])
            ok = np.zeros(len(b), bool)
            for k in range(len(b)):
                x, y = (np.frombuffer(d[o[k] : o[k + 1]].tobytes(), "<u8") for d, o in ((xd, xo), (yd, yo)))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield batch(a=b["a"].filter(keep), b=b["b"].filter(keep))

    return run


def _common(xs: list[np.ndarray], ys: list[np.ndarray] | None, width: int = 2048) -> np.ndarray:
    """The size of the intersection of every set of ``xs`` with every one of ``ys``, as matrix products; without
    ``ys``, of every two sets of ``xs`` (of one with itself, no figure)."""
    alone, ys = ys is None, xs if ys is None else ys
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not xs or not ys:
        return out
    x, y = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(x, y)
    if alone:
        both, times = np.unique(x, return_counts=True)
        both = both[times > 1]
    rx, ry = (np.repeat(np.arange(len(v)), [len(a) for a in v]) for v in (xs, ys))
    kx, ky = (np.searchsorted(both, v) for v in (x, y))
    okx, oky = ((k < len(both)) & (both[np.minimum(k, len(both) - 1)] == v) if len(both) else np.zeros(len(v), bool) for k, v in ((kx, x), (ky, y)))
    for lo in range(0, len(both), width):
        m = []
        for r, k, ok, n in ((rx, kx, okx, len(xs)), (ry, ky, oky, len(ys))):
            here = ok & (k >= lo) & (k < lo + width)
            a = np.zeros((n, min(width, len(both) - lo)), np.float32)
            a[r[here], k[here] - lo] = 1
            m.append(a)
        out += m[0] @ m[1].T
    return out


def _between(percent: int):
    """Compare two blocks of a posting list, or one with itself, on full sets: links that join components."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side, ids, label = t["side"].to_numpy(), t["id"].to_numpy(), t["comp"].to_numpy().copy()
        data, off = utf8(t["set"])
        sets = [np.frombuffer(data[off[k] : off[k + 1]].tobytes(), "<u8") for k in range(len(ids))]
        n = np.diff(off) // 8
        left, right = (np.flatnonzero((side == s) | (side == 2)) for s in (0, 1))
        common = _common([sets[k] for k in left], None if (side == 2).all() else [sets[k] for k in right])
        out: list[tuple[int, int]] = []
        for i, shared in zip(left, common, strict=True):
            both = shared.astype(np.int64)
            near = 100 * both >= percent * (n[i] + n[right] - both)
            while len(other := right[near & (label[right] != label[i])]):
                out.append((int(min(ids[i], ids[other[0]])), int(max(ids[i], ids[other[0]]))))
                label[label == label[other[0]]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


class MinHashJoin:
    """The inverted join over one table of documents; see the module's text."""

    def __init__(self, docs: DataFrame, shingle: int = 5, percent: int = 75, coords: int = 64, matches: int = 30, rounds: int = 2, block: int = 8 << 20) -> None:
        self.docs, self.shingle, self.percent, self.least, self.rounds, self.block = doc_texts(docs), shingle, percent, matches, rounds, block
        sig = self.docs.mapInArrow(_sign(shingle, coords), "doc_id long, n_shingles long, s0 long, s1 long, sig binary")
        self.signed = written(sig, "minhash-signed")
        some = self.signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = some.groupBy("s0", "s1", "n_shingles").agg(F.min("doc_id").alias("id"))
        self.classes = written(classes, "minhash-classes")
        reps = some.join(self.classes.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
        self.reps = written(reps.select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id"]), "minhash-reps")

    def postings(self) -> DataFrame:
        """(post, id): the kept prefix of each representative's postings, those with at least two members."""
        n = F.octet_length("sig") / 4
        words = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.concat(F.hex(k), F.lit(":"), F.hex(F.substring("sig", k * 4 + 1, F.lit(4)))))
        posts = self.reps.select("id", F.explode(words).alias("word")).select("id", F.xxhash64("word").alias("post"))
        many = posts.groupBy("post").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        kept = posts.join(many, "post").withColumns({
            "m": F.count(F.lit(1)).over(W.partitionBy("id")), "r": F.row_number().over(W.partitionBy("id").orderBy("n", "post")),  # one signature a group
        })
        return kept.filter(F.col("r") <= F.col("m") - self.least + 1).select("post", "id")

    def sets(self, posts: DataFrame) -> DataFrame:
        """The full shingle sets of the representatives that are posted at all."""
        texts = self.docs.join(posts.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return texts.mapInArrow(_sets(self.shingle), "id long, n long, set binary").dropDuplicates(["id"])

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that are links: by signature, then by full sets."""
        sig = self.reps
        near = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        near = near.select("a", "b", "sa", "sb").mapInArrow(_agree(self.least), "a long, b long")
        both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
        return both.select("a", "b", "xa", "xb").mapInArrow(_similar(self.percent), "a long, b long")

    def homes(self, lists: DataFrame) -> DataFrame:
        """(id, home): the longest list of each member."""
        at = lists.join(lists.groupBy("post").agg(F.count(F.lit(1)).alias("n")), "post")
        return at.groupBy("id").agg(F.max(F.struct("n", "post")).getField("post").alias("home"))

    def blocks(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """The members (post, id, comp, same) by the pairs of blocks (lo, hi) they are compared in; those that are ``same``
        needn't be. A member counts 2 KB more than its set, which bounds the members of a block."""
        at = lists.join(sets.select("id", (F.col("n") * 8 + 2048).alias("bytes")), "id")
        sizes = at.groupBy("post").agg(
            F.min_by("same", F.xxhash64("id")).alias("first"), F.sum("bytes").alias("bytes_all"), F.min("same").alias("s0"), F.max("same").alias("s1")
        ).filter("s0 <> s1")
        at = at.join(sizes, "post").withColumn("in_first", F.col("same") == F.col("first"))
        # Members that are the same, most often the most, lie in blocks of their own and aren't compared with each other.
        k = F.floor(F.col("bytes_all") / self.block) + 1
        blk = F.pmod(F.xxhash64("id"), k) + F.when(F.col("in_first"), 0).otherwise(k)
        at = at.withColumns({"blk": blk, "k": k})
        met = at.withColumn("other", F.explode(F.sequence(F.when(F.col("in_first"), F.col("k")).otherwise(0), 2 * F.col("k") - 1)))
        side = F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1)
        return met.select("post", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), side.alias("side"), "id", "comp")

    def rest(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components (comp) of members that share a posting list and aren't ``same``."""
        met = self.blocks(lists, sets).join(sets.select("id", "set"), "id")
        return met.groupBy("post", "lo", "hi").applyInArrow(_between(self.percent), "a long, b long")

    def links(self) -> DataFrame:
        """Confirmed links (a, b) that connect every class to all it is similar to, by one path or another."""
        posts = written(self.postings(), "minhash-posts")
        sets = written(self.sets(posts), "minhash-sets")
        links, comp, homes = None, None, None
        for step in range(self.rounds + 2):
            at = posts.withColumn("comp", F.col("id")) if comp is None else posts.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
            mixed = at.groupBy("post").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
            at = at.join(mixed.select("post"), "post", "left_semi")
            if step < self.rounds:
                # The pivots of a list: the member first in an order that each round shuffles anew, and the first one of another component.
                order = F.struct(F.xxhash64("id", F.lit(step)).alias("h"), "id") if step else F.struct(F.col("id").alias("h"), "id")
                at = at.join(at.groupBy("post").agg(F.min_by("id", order).alias("p"), F.min_by("comp", order).alias("pc")), "post")
                at = at.join(at.filter("comp <> pc").groupBy("post").agg(F.min_by("id", order).alias("q")), "post")
                at = at.withColumn("pivot", F.when(F.col("comp") == F.col("pc"), F.col("q")).otherwise(F.col("p")))
                found = self.confirm(at.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), sets)
            elif homes is None:
                homes = written(self.homes(at), "minhash-homes")
                mine = at.join(homes, "id").filter("post = home").drop("home")
                found = self.rest(mine.withColumn("same", F.col("comp")), sets).distinct()
            else:
                found = self.rest(at.join(homes.withColumnRenamed("home", "same"), "id"), sets).distinct()
            links = written(found if links is None else found.union(links), "minhash-links")
            comp = components(links)
        return links

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), one row for each row of the documents."""
        comp = components(self.links())
        of_class = self.classes.join(comp, "id", "left").select("s0", "s1", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        joined = self.signed.drop("sig").join(of_class, ["s0", "s1", "n_shingles"], "left")
        mine = F.coalesce("component_id", "doc_id")
        mine = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(mine)
        return joined.select("doc_id", "n_shingles", mine.alias("component_id"), F.col("doc_id").eqNullSafe(mine).alias("kept"))


def minhash_dedup(docs: DataFrame, **params: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; ``params`` as in MinHashJoin."""
    return MinHashJoin(docs, **params).result()
