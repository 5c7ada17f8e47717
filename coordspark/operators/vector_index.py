"""Stored forms of the vectors of a point table: an inverted file for
approximate search (V5) and int8 codes for quantized search (V6).

Inverted file: ``lists`` points, those with the smallest md5 of their id, are
leaders; every point lies in the list of its nearest leader, and the table
is partitioned by list. A search reads only the partitions of the ``probes``
lists whose leaders are nearest to the query: fewer probes, fewer files.
Leaders are the only thing held outside the table; their number is a
parameter and their vectors are bounded in bytes.

Codes: the clip bound is found once, when the index is written, and stored
with it; a search scans ids and codes alone (a quarter of the bytes; the
vector column is not read) and rescores ``oversampling * k`` rows, fetched by
id, on their float vectors.

An index is written to a fresh path and never changed; a rebuilt one gets a
path of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collect_bounded
from .vectors import DEFAULT_MIN_SCORE, OVERSAMPLING, knn_search, quantile_bound, quantize

#: Bytes of leader vectors (float64) that a task or the driver may hold.
MAX_LEADER_BYTES = 64 * 1024 * 1024
#: Files that a list's points are spread over when an index is written.
FILES_PER_LIST = 4


# --- inverted file (V5) ---------------------------------------------------------------

def leaders(points: DataFrame, lists: int, vector_col: str = "vector") -> DataFrame:
    """The leaders ``(list, id, vector)``, numbered by the md5 of their id (all-zero and NULL vectors lead nothing)."""
    from pyspark.sql import Window

    usable = F.exists(vector_col, lambda x: x != 0)
    top = (points.filter(usable).select("id", vector_col, F.md5(F.col("id").cast("string")).alias("h"))
           .orderBy("h").limit(lists))  # TakeOrdered: `lists` rows travel
    w = Window.orderBy("h")  # over `lists` rows
    return top.select((F.row_number().over(w) - 1).cast("int").alias("list"), "id", F.col(vector_col).alias("vector"))


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _leader_matrix(lead: DataFrame, lists: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(collect_bounded(lead.select("list", "vector"), lists, "leaders"), key=lambda r: r["list"])
    m = _unit([r["vector"] for r in rows]) if rows else np.zeros((0, 0))
    if m.nbytes > MAX_LEADER_BYTES:
        raise ValueError(f"leaders take {m.nbytes} bytes; the bound is {MAX_LEADER_BYTES}")
    return np.array([r["list"] for r in rows], dtype=np.int32), m


def _nearest_leader(numbers: np.ndarray, m: np.ndarray, vector_col: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = (_unit(list(pdf[vector_col])) @ m.T).argmax(axis=1)
                yield pdf.assign(list=numbers[at])

    return run


def write_inverted_file(points: DataFrame, path: str, lists: int = 64, vector_col: str = "vector") -> str:
    """V5: write the points (those with a vector) by list of their nearest leader, and the leaders."""
    points = points.filter(F.col(vector_col).isNotNull())
    leaders(points, lists, vector_col).write.parquet(path + "/leaders")
    numbers, m = _leader_matrix(points.sparkSession.read.parquet(path + "/leaders"), lists)
    schema = T.StructType([*points.schema.fields, T.StructField("list", T.IntegerType())])
    dealt = points.mapInPandas(_nearest_leader(numbers, m, vector_col), schema) if len(m) else points.withColumn("list", F.lit(0))
    # a list may hold any share of the points: its rows go to several tasks and files
    dealt = dealt.repartition("list", F.pmod(F.xxhash64("id"), F.lit(FILES_PER_LIST)))
    dealt.write.partitionBy("list").parquet(path + "/points")
    dealt.limit(0).write.parquet(path + "/columns")  # an empty partitioned table has no file to tell its columns
    return path


def probed_points(spark: SparkSession, path: str, query: list[float], probes: int) -> DataFrame:
    """The points of the ``probes`` lists nearest to the query (partition pruning on ``list``)."""
    numbers, m = _leader_matrix(spark.read.parquet(path + "/leaders"), 1 << 24)
    points = spark.read.schema(spark.read.parquet(path + "/columns").schema).parquet(path + "/points")
    if not len(m):
        return points
    near = np.argsort(-(m @ _unit([query])[0]), kind="stable")[:probes]
    return points.filter(F.col("list").isin([int(n) for n in numbers[near]]))


def knn_inverted_file(spark: SparkSession, path: str, query: list[float], k: int = 10, probes: int = 16,
                      min_score: float = DEFAULT_MIN_SCORE, pred: Column | None = None, vector_col: str = "vector") -> DataFrame:
    """V5: exact scores over the probed lists only; with as many probes as lists it equals V1."""
    return knn_search(probed_points(spark, path, query, probes).drop("list"), query, k, min_score, pred, vector_col)


# --- int8 codes (V6) ------------------------------------------------------------------

def write_codes(points: DataFrame, path: str, bound: float | None = None, quantile: float = 0.99, vector_col: str = "vector") -> str:
    """V6: write the points with their codes and the clip bound (given, or the quantile of |x| over all elements)."""
    bound = quantile_bound(points, quantile, vector_col) if bound is None else bound
    coded = points.filter(F.col(vector_col).isNotNull()).withColumn("code", quantize(F.col(vector_col), bound))
    coded.write.parquet(path + "/points")
    points.sparkSession.createDataFrame([(float(bound),)], "bound double").write.parquet(path + "/bound")
    return path


def code_candidates(spark: SparkSession, path: str, query: list[float], n: int, pred: Column | None = None) -> DataFrame:
    """The ``n`` ids with the largest integer product of codes; reads no float vector."""
    bound = spark.read.parquet(path + "/bound").first()["bound"]
    q = np.clip(np.asarray(query, dtype=np.float64), -bound, bound) / bound * 127
    codes = F.array(*[F.lit(int(x)) for x in np.sign(q) * np.floor(np.abs(q) + 0.5)])
    approx = F.aggregate(F.zip_with("code", codes, lambda x, y: x.cast("int") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    points = spark.read.parquet(path + "/points")
    points = points if pred is None else points.filter(pred)
    return points.select("id", approx.alias("approx")).orderBy(F.desc("approx"), "id").limit(n).select("id")


def knn_codes(spark: SparkSession, path: str, query: list[float], k: int = 10, min_score: float = DEFAULT_MIN_SCORE,
              pred: Column | None = None, oversampling: float = OVERSAMPLING, vector_col: str = "vector") -> DataFrame:
    """V6: candidates by codes, then their rows by id (at most ``oversampling * k`` ids are broadcast) and an exact rescore."""
    n = max(k, int(np.ceil(k * oversampling)))
    ids = F.broadcast(code_candidates(spark, path, query, n, pred))
    rows = spark.read.parquet(path + "/points").drop("code").join(ids, "id", "left_semi")
    return knn_search(rows, query, k, min_score, None, vector_col)


# --- sign bits (X2) -------------------------------------------------------------------

#: Candidates fetched per hit before the rescore of a search by sign bits.
BIT_OVERSAMPLING = 3.0


def sign_words(vec: Column, dim: int) -> Column:
    """The signs of a vector (above 0: one) packed into BIGINT words of 64."""
    def word(w: int) -> Column:
        places = F.sequence(F.lit(64 * w), F.lit(min(dim, 64 * w + 64) - 1))
        bit = lambda i: F.when(F.get(vec, i) > 0, F.expr("1L")).otherwise(F.lit(0).cast("long"))
        # the lowest bit is the last component of the word
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))

    return F.array(*[word(w) for w in range(-(-dim // 64))])


def write_sign_bits(points: DataFrame, path: str, dim: int, vector_col: str = "vector") -> str:
    """Write the points with a vector of ``dim`` components and their sign bits (1/32 of the vector's bits)."""
    coded = points.filter(F.size(vector_col) == dim).withColumn("bits", sign_words(F.col(vector_col), dim))
    coded.write.parquet(path)
    return path


def knn_sign_bits(spark: SparkSession, path: str, query: list[float], k: int = 10, min_score: float = DEFAULT_MIN_SCORE,
                  pred: Column | None = None, oversampling: float = BIT_OVERSAMPLING, vector_col: str = "vector") -> DataFrame:
    """Candidates by Hamming distance of the bits (one scan of ids and words), an exact rescore of their rows."""
    words = []
    for at in range(0, len(query), 64):
        word = 0
        for x in query[at:at + 64]:
            word = (word << 1) | (x > 0)
        words.append(word - (1 << 64) if word >= 1 << 63 else word)
    points = spark.read.parquet(path)
    mine = points if pred is None else points.filter(pred)
    away = sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.lit(w).cast("long"))) for i, w in enumerate(words))
    ids = mine.select("id", away.alias("away")).orderBy("away", "id").limit(max(k, int(np.ceil(k * oversampling)))).select("id")
    return knn_search(points.drop("bits").join(F.broadcast(ids), "id", "left_semi"), query, k, min_score, None, vector_col)

