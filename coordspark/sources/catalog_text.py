"""Read and parse the encoded field catalog.

A catalog line holds nine pipe-separated ``prefix*value`` columns:
model id, field id, field name, label, type, model name, data location,
stored flag (``Yes``), and the primary reference ``model_id^field_id*``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import js_parse_int, js_trim

CATALOG_COLUMNS = (
    "line_no", "model_id", "field_id", "field_name", "field_label", "field_type",
    "model_name", "primary_data_location", "stored", "primary_model_id",
    "primary_field_id", "raw_encoded",
)


class Split(NamedTuple):
    """Rows that parsed (``good``) and the quarantined rest (``bad``)."""

    good: DataFrame
    bad: DataFrame


def read_catalog_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a catalog file with their line number, blank lines dropped.

    The file is read whole (``wholetext``) so that line numbers are exact file
    positions: the coordinate lookup (Q1) and duplicate names (Q9) depend on
    file order. A catalog is bounded by the number of fields of the ERP
    schema (tens of thousands of lines), so one file per task is fine.
    """
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.split(F.col("value"), "\n", -1)).alias("pos", "value"))
    return (lines.select((F.col("pos") + 1).cast("long").alias("line_no"), "value")
            .filter(F.length(js_trim(F.col("value"))) > 0))


def extract_value(seg: Column) -> Column:
    """Text after the first ``*``, minus one trailing ``*``; without ``*`` the text itself."""
    return F.when(F.instr(seg, "*") > 0,
                  F.regexp_extract(seg, r"(?s)^[^*]*\*(.*?)\*?$", 1)).otherwise(seg)


def parse_catalog(lines: DataFrame) -> Split:
    """S2 + S3: parse ``(line_no, value)`` rows into catalog rows.

    Lines with fewer than nine columns or non-numeric ids go to ``bad``.
    """
    pre = lines.select("line_no", js_trim(F.col("value")).alias("line"))
    pre = pre.select("line_no", "line", F.split(F.col("line"), r"\|", -1).alias("cols"))
    pre = pre.select("line_no", "line", F.size("cols").alias("n_cols"),
                     *[F.get(F.col("cols"), i).alias(f"c{i}") for i in range(9)])
    vals = pre.select("line_no", "line", "n_cols",
                      *[extract_value(F.col(f"c{i}")).alias(f"v{i}") for i in range(9)])
    ref = F.col("v8")
    has_caret = F.instr(ref, "^") > 0
    ref_parts = F.split(ref, r"\^", -1)
    parsed = vals.select(
        "line_no", "n_cols",
        js_parse_int(F.col("v0")).alias("model_id_l"),
        js_parse_int(F.col("v1")).alias("field_id_l"),
        F.col("v2").alias("field_name"),
        F.col("v3").alias("field_label"),
        F.col("v4").alias("field_type"),
        F.col("v5").alias("model_name"),
        F.col("v6").alias("primary_data_location"),
        (F.lower(F.col("v7")) == F.lit("yes")).alias("stored"),
        F.when(has_caret, F.coalesce(F.get(ref_parts, 0), F.lit(""))).otherwise(F.coalesce(ref, F.lit(""))).alias("primary_model_id"),
        F.when(has_caret, F.coalesce(F.get(ref_parts, 1), F.lit(""))).otherwise(F.lit("")).alias("primary_field_id"),
        F.col("line").alias("raw_encoded"),
    )
    ok = (F.col("n_cols") >= 9) & F.col("model_id_l").isNotNull() & F.col("field_id_l").isNotNull()
    good = parsed.filter(ok).select(
        "line_no",
        F.col("model_id_l").cast("int").alias("model_id"),
        F.col("field_id_l").cast("int").alias("field_id"),
        *CATALOG_COLUMNS[3:],
    )
    bad = parsed.filter(~ok).select(
        "line_no", "raw_encoded",
        F.when(F.col("n_cols") < 9, F.lit("not enough columns")).otherwise(F.lit("invalid ids")).alias("reason"),
    )
    return Split(good, bad)
