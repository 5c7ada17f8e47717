"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``docs`` for the rows that stay. Rows are taken out by an anti join on what a stage
rejects, so rows with a null doc_id, to which no decision can be tied, stay (toxicity is decided row by row).
Rows that repeat both doc_id and text share every decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm.best_fit import best_fit_pack
from coordspark.llm.common import written
from coordspark.llm.decontaminate import contaminated
from coordspark.llm.grace_dedup import grace_dedup
from coordspark.llm.minhash_join import minhash_dedup
from coordspark.llm.tokens import word_bpe
from coordspark.llm.toxicity_kn import without_toxic
from coordspark.session import table_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7 go."""
    return without_toxic(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    gone = grace_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.sha2(text.cast("binary"), 256) == F.col("gone_sha"))
    return docs.join(written(gone, "pipeline-gone"), same, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    gone = minhash_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(written(gone, "pipeline-gone"), F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    gone = contaminated(docs, spark.read.parquet(table_path(sf_dir, "benchmark"))).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(written(gone, "pipeline-gone"), F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return best_fit_pack(docs, word_bpe(), capacity=2048, end_id=0)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: The scoring and packing stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
