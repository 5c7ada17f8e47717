"""Shards of nearly equal bytes by a k-d tree with distributed weighted medians.

Items are groups of equal texts, weighted with their bytes; a group of more than 1/``pieces`` of a shard
is dealt into smaller ones by doc_id, so that no group can make a shard too large. Each item has a point
in the metadata space (language, source, size, place in doc_id order). A node that must give k shards is
cut along its widest dimension, where the items below hold floor(k/2)/k of the weight; nodes are
cut level by level until every leaf is one shard.

A cut needs no sort: a histogram per node finds the bin in which the weight is reached, a second one
cuts the points of that bin by a hash of the item. What the
driver gets is one row per node and step, and it keeps the cuts (one per shard).

Defined results: null text has 16 bytes, null metadata counts as the lowest value; equal rows are items
like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coordspark.llm.common import batch, doc_texts, written

DIMS = ("d_lang", "d_source", "d_size", "d_doc")
_BINS = 4096


def _name_place(col: str) -> Column:
    """A string's place in byte order, 0 to 1, by its first six bytes."""
    padded = F.rpad(F.substring(F.hex(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")), 1, 12), 12, "0")
    return F.conv(padded, 16, 10).cast("double") / F.lit(float(1 << 48))


def _items(docs: DataFrame, shards: int, pieces: int) -> tuple[DataFrame, DataFrame]:
    """Each document with its item; the items with weight and point."""
    has = set(docs.columns)
    meta = [_name_place(c) if c in has else F.lit(0.0) for c in ("lang", "source")]
    rows = doc_texts(docs, meta[0].alias("d_lang"), meta[1].alias("d_source"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(
        "doc_id", "d_lang", "d_source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("g"), F.xxhash64(F.coalesce("doc_id", F.lit(-1))).alias("h"),
    )
    rows = written(rows, "shard-rows")
    share = float(rows.agg(F.sum("size")).first()[0] or 0) / shards / pieces
    # At most shards * pieces groups can be larger than that.
    large = rows.groupBy("g").agg(F.sum("size").alias("w")).filter(F.col("w") > share).select("g", F.ceil(F.col("w") / F.lit(max(share, 1.0))).alias("cut"))
    rows = rows.join(F.broadcast(large), "g", "left").withColumn("piece", F.when(F.col("cut").isNull(), 0).otherwise(F.pmod("h", "cut"))).drop("cut")
    items = rows.groupBy("g", "piece").agg(
        F.sum("size").alias("w"), F.min("d_lang").alias("d_lang"), F.min("d_source").alias("d_source"), F.max(F.log2("size")).alias("d_size"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d_doc"),
    )
    return rows, written(items.withColumn("tie", F.pmod(F.xxhash64("g", "piece"), F.lit(1 << 30)).cast("double")), "shard-items")


def _with_node(items: DataFrame, cuts: dict[int, tuple]) -> DataFrame:
    """The leaf of each item below the cuts so far. Node n has the children 2n and 2n + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b[c].to_numpy() for c in (*DIMS, "tie")}
            node = np.ones(len(b), np.int64)
            for n in sorted(cuts):  # parents come before their children
                dim, low, high, tie = cuts[n]
                mine = node == n
                v = col[dim][mine]
                left = (v < low) | ((v <= high) & (col["tie"][mine] < tie))
                node[mine] = 2 * n + ~left
            yield batch(**{c: b[c] for c in b.schema.names}, node=node)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, f"{types}, node long")


def _reach(items: DataFrame, nodes: dict[int, dict], col: str | None, lo: str, hi: str) -> dict[int, tuple[float, float, float, float]]:
    """In each node, among items whose value lies between node[lo] and node[hi]: the bin in which the weight
    still wanted is reached, as (its first value, its last, the weight before it, its weight). The value is
    that of ``col``, by default of the node's own dimension; with ``col`` only items between "low" and "high"
    of the node's dimension count."""
    spark = items.sparkSession
    rows = [(n, DIMS.index(d["dim"]) + 1, float(d[lo]), float(d[hi]), float(d.get("low", d["a"])), float(d.get("high", d["b"])), float(d["want"])) for n, d in nodes.items()]
    at = spark.createDataFrame(rows, "node long, k int, a double, b double, low double, high double, want double")  # a row per node
    own = F.element_at(F.array(*DIMS), F.col("k"))
    x = items.join(F.broadcast(at), "node").withColumn("own", own).filter("own BETWEEN low AND high").withColumn("v", F.col(col) if col else F.col("own")).filter("v BETWEEN a AND b")
    bin_ = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * _BINS), F.lit(_BINS - 1))).otherwise(0)
    hist = x.groupBy("node", "want", bin_.alias("bin")).agg(F.sum("w").alias("w"), F.min("v").alias("first"), F.max("v").alias("last"))
    run = hist.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")))  # at most _BINS rows a node
    found = run.filter("upto >= want").groupBy("node").agg(F.min_by(F.struct("first", "last", (F.col("upto") - F.col("w")).alias("before"), "w"), "bin").alias("r"))
    return {r["node"]: tuple(map(float, r["r"])) for r in found.collect()}


def kd_tree(items: DataFrame, shards: int) -> tuple[dict[int, tuple], dict[int, int]]:
    """The cuts (node: dimension, below, equal up to, tie below) and the shard of each leaf."""
    leaves, cuts, whole = {1: shards}, {}, {}
    while open_nodes := [n for n, k in leaves.items() if k > 1]:
        at = _with_node(items, cuts).filter(F.col("node").isin(open_nodes))
        # One row per node, of which there are fewer than shards.
        wide = at.groupBy("node").agg(F.sum("w").alias("w"), *[F.min(d).alias(f"{d}_a") for d in DIMS], *[F.max(d).alias(f"{d}_b") for d in DIMS]).collect()
        nodes = {}
        for r in wide:
            extent = {d: r[f"{d}_b"] - r[f"{d}_a"] for d in DIMS}
            whole = whole or {d: x or 1.0 for d, x in extent.items()}  # the first node is the whole table
            dim, k = max(DIMS, key=lambda d: extent[d] / whole[d]), leaves[r["node"]]
            nodes[r["node"]] = {"dim": dim, "a": r[f"{dim}_a"], "b": r[f"{dim}_b"], "t0": 0.0, "t1": float(1 << 30), "want": r["w"] * (k // 2) / k}
        for n, (first, last, before, _) in (_reach(at, nodes, None, "a", "b") if nodes else {}).items():
            nodes[n] |= {"low": first, "high": last, "want": nodes[n]["want"] - before}
        for n, (first, last, before, w) in (_reach(at, nodes, "tie", "t0", "t1") if nodes else {}).items():
            nodes[n]["cut"] = last + 1 if 2 * (nodes[n]["want"] - before) >= w else first
        for n in open_nodes:
            d = nodes.get(n)  # a node without items gets any cut
            cuts[n] = (d["dim"], d["low"], d["high"], d["cut"]) if d else (DIMS[0], 0.0, 0.0, 0.0)
            k = leaves.pop(n)
            leaves |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
    return cuts, {n: i for i, n in enumerate(sorted(leaves, key=lambda n: f"{n:b}"))}


def kd_shards(docs: DataFrame, shards: int = 40, pieces: int = 32, ranked_rows: int = 250_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, under the law ``bytes``.

    ``ranked_rows``: a task numbers about so many rows of a shard; larger shards are numbered in groups.
    """
    rows, items = _items(docs, shards, pieces)
    cuts, shard_of = kd_tree(items, shards)
    shard = docs.sparkSession.createDataFrame(list(shard_of.items()), "node long, shard int")  # a row per shard
    placed = _with_node(items, cuts).join(F.broadcast(shard), "node").select("g", "piece", "shard")
    out = written(rows.join(placed, ["g", "piece"]).select("doc_id", "size", "text_crc32", "shard", "h"), "shard-placed")
    groups = out.count() // shards // ranked_rows + 1
    out = out.withColumn("grp", F.pmod(F.shiftright("h", 8), F.lit(groups)))
    sizes = out.groupBy("shard", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "grp", (F.sum("n").over(W.partitionBy("shard").orderBy("grp")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy("shard", "grp").orderBy("doc_id", "text_crc32"))
    return out.withColumn("nth", nth).join(F.broadcast(before) if groups < 1000 else before, ["shard", "grp"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
