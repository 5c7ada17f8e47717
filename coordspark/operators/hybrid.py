"""Hybrid search (X1): words and vectors ranked apart, then fused by rank.

The word side is a set of tables: postings ``(term, id, tf)`` partitioned by a
hash of the term, so a search reads the partitions of its own terms; text
lengths; and the totals. BM25 is a join of the query's few terms with their
postings and one aggregate per text. The fusion is a full outer join of the two
short rankings. A term that a third of all texts hold is a third of its
partition's rows, read by many tasks; the aggregate is keyed by text.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: BM25's saturation and length weight; the rank constant of the fusion (fixed values).
K1, B, FUSION = 1.2, 0.75, 60
#: Partitions of the postings by term.
TERM_BUCKETS = 64
#: Decimals up to which scores count as equal when they are ranked.
SCORE_DECIMALS = 9


def terms(text: Column) -> Column:
    """The words of a text: runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def write_text_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> str:
    """Postings, lengths and totals of ``docs`` (texts without a word have length 0 and no posting)."""
    words = docs.select(F.col(id_col).cast("long").alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    lengths = words.select("id", F.size("words").cast("long").alias("len"))
    lengths.write.parquet(path + "/lengths")
    posts = words.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    posts.withColumn("bucket", _bucket(F.col("term"))).write.partitionBy("bucket").parquet(path + "/postings")
    lengths = docs.sparkSession.read.parquet(path + "/lengths")
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).write.parquet(path + "/totals")
    return path


def bm25(spark: SparkSession, path: str, query: list[str], n: int = 100) -> DataFrame:
    """``(id, score, rank)`` of the n best texts for the distinct words of a query."""
    wanted = sorted({t for t in query if t})
    # crc32 has the same values on both sides; a literal list, so partitions are pruned
    buckets = sorted({zlib.crc32(t.encode()) % TERM_BUCKETS for t in wanted})
    posts = spark.read.schema("term string, id long, tf long, bucket int").parquet(path + "/postings")
    posts = posts.filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted)).select("term", "id", "tf")
    totals = spark.read.parquet(path + "/totals").first()
    count, mean = totals["n"], totals["mean"] or 0.0
    df = F.broadcast(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row per word of the query
    idf = F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    scored = (posts.join(df, "term").join(spark.read.parquet(path + "/lengths"), "id")
              .groupBy("id").agg(F.round(F.sum(part), SCORE_DECIMALS).alias("score")))
    return ranked(scored, n)


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """The n best of ``(id, score)`` with their rank."""
    best = scored.orderBy(F.desc("score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # n rows


def fuse(words: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two rankings ``(id, rank)``: ``(id, score, word_rank, vector_rank)``."""
    both = (words.select("id", F.col("rank").alias("word_rank"))
            .join(vectors.select("id", F.col("rank").alias("vector_rank")), "id", "full_outer"))
    score = sum(F.coalesce(F.lit(1.0) / (FUSION + F.col(c)), F.lit(0.0)) for c in ("word_rank", "vector_rank"))
    return both.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def text_index(docs: DataFrame, **cols: str) -> str:
    """``write_text_index`` into a fresh folder of the shared space."""
    return write_text_index(docs, scratch_path(docs.sparkSession, "text-index"), **cols)
