"""Merkle manifest of a table as a SHA-256 midstate tree.

A node is the lowercase hex digest of what it stands for. A parent hashes up to eight children's digests one after
the other; as hex text a digest is 64 bytes, one block of SHA-256, so the hash's state before each child slot is eight
words and nothing more. Parents keep copies of these states. To replace a child, the parent's state before that
slot is resumed and fed with the replacement and the right siblings only; nothing to the left is hashed again.

1. Leaves are digests of records, made by DataFrame functions where the texts lie; texts are never shuffled.
2. Leaves are sorted by range and numbered per group from the counts of the ranges.
3. ``levels`` levels of a tree at a time are built by Spark in pages, one for up to 8^levels consecutive nodes: a page
   is a row with the digests of its nodes and the midstates of its parents. The pages' tops are the nodes of
   the next round, until each group has one node. Groups' tops are in turn the leaves of one tree over all.
4. ``fold`` brings replaced leaves together with their page and, for what lies above it, with the path from the
   page to the root: for each level the slot, the state before it and the siblings.

The hash function runs on many nodes at once (``compress``); hashlib's states can't be stored. No task holds more than
a page and its leaves, however many rows a group has.

Defined results: null fields are ``-``, other values of any type count in their text form; rows with a null doc_id
come first and are never tampered with; rows that repeat a doc_id are ordered by leaf. A lone leaf is its group's
top; the proof of a node without siblings at any level is the digest of nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import batch, written

FAN = 8


# --- SHA-256 on columns of words: fixed values by their rule, FIPS 180-4 ---

def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _fraction(p: int, root: int) -> int:
    """The first 32 bits of the fraction of p's square or cube root, in whole numbers."""
    x, lo, hi = p << (32 * root), 0, p << 32
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**root <= x else (lo, mid - 1)
    return lo & 0xFFFFFFFF


START = np.array([_fraction(p, 2) for p in _primes(8)], np.uint32)
ROUND = np.array([_fraction(p, 3) for p in _primes(64)], np.uint32)
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "little") for b in range(256)], "<u2")


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n or 1) each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        p = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + ROUND[t])
        q = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + p, c, b, a, p + q
    return state + np.stack([a, b, c, d, e, f, g, h])


def finish(state: np.ndarray, n_blocks: np.ndarray | int) -> np.ndarray:
    """The digests (8, n) of states that have taken ``n_blocks`` whole blocks."""
    n = np.atleast_1d(np.asarray(n_blocks, np.uint64)) * np.uint64(512)
    block = np.zeros((16, len(n)), np.uint32)
    block[0], block[14], block[15] = 0x80000000, n >> np.uint64(32), n & np.uint64(0xFFFFFFFF)
    return compress(state, block)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The hex text of digests (8, n) as one block (16, n) each."""
    raw = np.ascontiguousarray(digest.T).astype(">u4").view(np.uint8).reshape(digest.shape[1], 32)
    return np.ascontiguousarray(_HEX[raw].view(np.uint8).reshape(-1, 64).view(">u4").T).astype(np.uint32)


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def _to_bytes(digest: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digest.T).astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def _from_bytes(col: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32)


# --- pages ---

def depth(nodes: int) -> int:
    """Levels of parents above so many nodes, until one is left."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def build_levels(nodes: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests (8, n) of each level, the given nodes first, and the midstates (8, n, FAN) of each level of parents."""
    digests, states = [nodes], []
    for _ in range(levels):
        below = hex_block(digests[-1])
        n = below.shape[1]
        parents = -(-n // FAN)
        state, kept = start(parents), np.zeros((8, parents, FAN), np.uint32)
        size = np.minimum(FAN, n - FAN * np.arange(parents))
        for slot in range(FAN):
            kept[:, :, slot] = state
            has = np.flatnonzero(size > slot)
            state[:, has] = compress(state[:, has], below[:, has * FAN + slot])
        digests.append(finish(state, size))
        states.append(kept)
    return digests, states


def _page(levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        digests, states = build_levels(_from_bytes(t["digest"]), min(levels, depth(t["total"][0].as_py())))
        blob = [np.concatenate([d.astype("<u4").reshape(-1) for d in digests]).tobytes(), np.concatenate([np.zeros(0, "<u4"), *[s.astype("<u4").reshape(-1) for s in states]]).tobytes()]
        return pa.table({"grp": t["grp"][:1], "page": t["page"][:1], "total": t["total"][:1], "n": pa.array([len(t)], pa.int64()), "levels": pa.array([len(states)], pa.int32()),
                         "digests": pa.array(blob[:1], pa.binary()), "states": pa.array(blob[1:], pa.binary()), "top": pa.array(_to_bytes(digests[-1])[:1], pa.binary())})

    return run


PAGE = "grp string, page long, total long, n long, levels int, digests binary, states binary, top binary"


def open_page(n: int, levels: int, digests: bytes, states: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What ``build_levels`` gave, from a stored page."""
    sizes = [n]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // FAN))
    d, s = np.frombuffer(digests, "<u4"), np.frombuffer(states, "<u4")
    at = 8 * np.cumsum([0, *sizes])
    to = 8 * FAN * np.cumsum([0, *sizes[1:]])
    return ([d[at[k] : at[k + 1]].reshape(8, -1).astype(np.uint32) for k in range(levels + 1)],
            [s[to[k] : to[k + 1]].reshape(8, -1, FAN).astype(np.uint32) for k in range(levels)])


#: One level of a path: slot, children of the parent, state before the slot, the children's digests.
STEP = np.dtype([("slot", "<u4"), ("size", "<u4"), ("state", "<u4", 8), ("run", "<u4", (FAN, 8))])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every node of a page up to the page's top."""
    for b in batches:
        for r in b.to_pylist():
            digests, states = open_page(r["n"], r["levels"], r["digests"], r["states"])
            path = np.zeros((r["n"], r["levels"]), STEP)
            for k in range(r["levels"]):
                node = np.arange(r["n"]) // FAN**k
                up, n = node // FAN, digests[k].shape[1]
                path["slot"][:, k], path["size"][:, k] = node % FAN, np.minimum(FAN, n - FAN * up)
                path["state"][:, k] = states[k][:, up, node % FAN].T
                for slot in range(FAN):
                    there = FAN * up + slot < n
                    path["run"][there, k, slot] = digests[k][:, (FAN * up + slot)[there]].T
            first = r["page"] * FAN**MidstateTree.LEVELS
            yield batch(grp=pa.array([r["grp"]] * r["n"], pa.string()), page=np.full(r["n"], r["page"], np.int64), node=np.arange(r["n"], dtype=np.int64) + first,
                        path=pa.array([path[i].tobytes() for i in range(r["n"])], pa.binary()))


class MidstateTree:
    """The trees of the groups of ``leaves`` (grp, pos, total, digest): pos from 0 without gaps, total leaves of the group."""

    LEVELS = 4

    def __init__(self, leaves: DataFrame, name: str = "midstate") -> None:
        width, nodes, self.rounds, tops = FAN**self.LEVELS, leaves, [], []
        while True:
            dealt = nodes.select("grp", "pos", "total", "digest", F.floor(F.col("pos") / width).cast("long").alias("page"))
            pages = written(dealt.groupBy("grp", "page").applyInArrow(_page(self.LEVELS), PAGE), f"{name}-pages")
            self.rounds.append(pages)
            tops.append(pages.filter(F.col("total") <= width).select("grp", F.col("top").alias("digest")))
            up = pages.filter(F.col("total") > width)
            nodes = up.select("grp", F.col("page").alias("pos"), F.ceil(F.col("total") / width).alias("total"), F.col("top").alias("digest"))
            if not up.select("page").take(1):
                break
        self.tops = tops[0]
        for t in tops[1:]:
            self.tops = self.tops.union(t)

    def above(self) -> DataFrame:
        """(grp, page, path): from the top of each page of the first round to the top of its group, where that is not itself."""
        up = None
        for pages in reversed(self.rounds[1:]):
            own = pages.mapInArrow(_steps, "grp string, page long, node long, path binary")
            if up is not None:
                own = own.join(up.select("grp", "page", F.col("path").alias("more")), ["grp", "page"], "left")
                own = own.withColumn("path", F.concat("path", F.coalesce("more", F.lit(b""))))
            up = own.select("grp", F.col("node").alias("page"), "path")
        return up if up is not None else self.rounds[0].filter("false").select("grp", "page", F.col("top").alias("path"))

    def paths(self) -> DataFrame:
        """(grp, pos, path) of every leaf to the top of its group."""
        own = self.rounds[0].mapInArrow(_steps, "grp string, page long, node long, path binary")
        up = self.above().select("grp", "page", F.col("path").alias("more"))
        return own.join(up, ["grp", "page"], "left").select("grp", F.col("node").alias("pos"), F.concat("path", F.coalesce("more", F.lit(b""))).alias("path"))


class Fold:
    """Replaced digests on their way up, with the hash of all siblings passed."""

    def __init__(self, digest: np.ndarray) -> None:
        self.digest, self.proof, self.passed = digest, start(digest.shape[1]), np.zeros(digest.shape[1], np.int64)

    def step(self, slot: np.ndarray, size: np.ndarray, state: np.ndarray, sibling: Callable[[int, np.ndarray], np.ndarray]) -> None:
        """One level: ``state`` is the parent's before ``slot``; ``sibling`` gives blocks (16, .) of a slot for some rows."""
        state = compress(state, hex_block(self.digest))
        for k in range(FAN):
            right = np.flatnonzero((k > slot) & (k < size))
            if len(right):
                state[:, right] = compress(state[:, right], sibling(k, right))
            other = np.flatnonzero((k != slot) & (k < size))
            if len(other):
                self.proof[:, other] = compress(self.proof[:, other], sibling(k, other))
                self.passed[other] += 1
        self.digest = finish(state, size)


def _fold(docs: pa.Table, pages: pa.Table) -> pa.Table:
    if not len(docs):
        return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}})
    r = pages.to_pylist()[0]
    digests, states = open_page(r["n"], r["levels"], r["digests"], r["states"])
    node = docs["pos"].to_numpy() - r["page"] * FAN**MidstateTree.LEVELS
    fold, n = Fold(_from_bytes(docs["new"])), len(docs)
    for k in range(r["levels"]):
        up, block = node // FAN, hex_block(digests[k])
        fold.step(node % FAN, np.minimum(FAN, block.shape[1] - FAN * up), states[k][:, up, node % FAN], lambda j, rows, up=up, block=block: block[:, FAN * up[rows] + j])
        node = up
    for s in np.frombuffer(r["path"], STEP):
        block, all_ = hex_block(np.ascontiguousarray(s["run"].T).astype(np.uint32)), np.ones(n, np.int64)
        fold.step(all_ * int(s["slot"]), all_ * int(s["size"]), np.repeat(s["state"].astype(np.uint32)[:, None], n, axis=1), lambda j, rows, block=block: block[:, j : j + 1])
    text = lambda d: pa.array([b.hex() for b in _to_bytes(d)], pa.string())
    whole = lambda c: pa.array([r[c].hex()] * n, pa.string())
    return pa.table({"doc_id": docs["doc_id"], "leaf": pa.array([b.hex() for b in docs["leaf"].to_pylist()], pa.string()), "subroot": whole("subroot"), "root": whole("root"),
                     "proof_sha256": text(finish(fold.proof, fold.passed)), "folded_root": text(fold.digest)})


# --- documents ---

def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length of the value's text, a colon and the text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(text: Column) -> Column:
    """The leaf (32 bytes) of a row of documents with this text."""
    return F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256))


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with pos and total per grp in the given order: sorted by range, numbered from the ranges' counts."""
    by = ["grp", *order]
    ranged = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = written(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "midstate-sorted")
    counts = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("total"))
    return ranged.join(counts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, every: int = 3) -> DataFrame:
    """Leaves, tops and proofs of ``docs`` by lang, and the root recomputed from each row's leaf with the text
    ``tampered`` (as given: A-Z in lower case) in the rows whose crc32 of doc_id ``every`` divides.
    """
    text = F.col("text")
    tampered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if tampered is None else tampered
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0)
    # null langs come before all others
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text.cast("string").alias("text"))
    leaves = rows.select("doc_id", grp.alias("grp"), record_digest(text).alias("digest"), F.when(hit, record_digest(tampered)).alias("changed"))
    leaves = written(leaves, "midstate-leaves")
    at = written(numbered(leaves, "doc_id", "digest"), "midstate-numbered")
    tree = MidstateTree(at.select("grp", "pos", "total", "digest"))
    tops = tree.tops.withColumns({"lang": F.col("grp"), "grp": F.lit("")})
    over = written(numbered(tops, "lang"), "midstate-tops")
    whole = MidstateTree(over.select("grp", "pos", "total", "digest"), "midstate-whole")
    ends = over.select("grp", "pos", "lang", F.col("digest").alias("subroot")).join(whole.paths(), ["grp", "pos"]).join(whole.tops.select("grp", F.col("digest").alias("root")), "grp")
    ends = ends.select(F.col("lang").alias("grp"), "subroot", "root", F.col("path").alias("last"))
    pages = tree.rounds[0].join(tree.above(), ["grp", "page"], "left").join(ends, "grp")
    pages = pages.select("grp", "page", "n", "levels", "digests", "states", F.concat(F.coalesce("path", F.lit(b"")), "last").alias("path"), "subroot", "root")
    asks = at.select("grp", F.floor(F.col("pos") / FAN**MidstateTree.LEVELS).cast("long").alias("page"), "pos", "doc_id", F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("new"))
    out = asks.groupBy("grp", "page").cogroup(pages.groupBy("grp", "page")).applyInArrow(_fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
