"""The registered queries of this subpackage and their DuckDB SQL.

Each takes (spark, sf_dir) and applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coordspark.llm import (
    best_fit, cross_parse, decontaminate, grace_dedup, kd_shards, line_crf, midstate_tree, minhash_join, one_bit_search, records_io, spelling_bloom,
    suffix_family, toxicity_kn,
)
from coordspark.llm.oracle import SQL as NEW_SQL
from coordspark.llm.tokens import word_bpe
from coordspark.session import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(_table(spark, sf_dir, "documents"), 40)


def op3_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_kn.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.minhash_dedup(_table(spark, sf_dir, "documents"))


def op5_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.grace_dedup(_table(spark, sf_dir, "documents"))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_io.token_records(_table(spark, sf_dir, "documents"), word_bpe(), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_cross_parse_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.language_id(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_pack(_table(spark, sf_dir, "documents"), word_bpe(), capacity=2048, end_id=0)


def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_bloom.spelling_groups(_table(spark, sf_dir, "documents"))


def op12_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midstate_tree.merkle_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_kd_shards, op3_toxicity_kneser_ney, op4_minhash_join, op5_grace_dedup, op6_bm25_decontamination,
    op7_token_records, op8_cross_parse_language, op9_best_fit_packing, op10_line_crf_quality, op11_spelling_bloom, op12_one_bit_search, op13_midstate_manifest,
)}

SQL = {
    "op5_grace_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
} | NEW_SQL
