"""Catalog operators: encoding map, coordinate lookup, statistics, model
discovery, column alignment, foreign-key edges and name suggestions.

The catalog is schema-sized (one row per field of the source system, tens of
thousands at most), so the small shuffles here are over a bounded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import RELATIONAL_TYPES, strip_id_suffix


def fields_of_model(catalog: DataFrame, model: str) -> DataFrame:
    """Catalog rows of one model."""
    return catalog.filter(F.col("model_name") == F.lit(model))


def encoding_map(catalog: DataFrame) -> DataFrame:
    """One row per (model, field) with its encoding prefix.

    many2one fields take the prefix of the target's id field
    (``primary_model_id^primary_field_id``); all others their own
    ``model_id^field_id``. Duplicate names in a model (Q9): the last row's
    attributes at the first row's position.
    """
    last = F.max_by(F.struct("model_id", "field_id", "field_type", "primary_data_location",
                             "primary_model_id", "primary_field_id"), F.col("line_no"))
    agg = (catalog.groupBy("model_name", "field_name")
           .agg(F.min("line_no").alias("line_no"), last.alias("r"))
           .select("model_name", "field_name", "line_no", "r.*"))
    m2o = F.col("field_type") == "many2one"
    return agg.select(
        "model_name", "model_id", "field_name", "line_no", "field_id", "field_type",
        F.when(m2o, F.concat_ws("^", "primary_model_id", "primary_field_id"))
        .otherwise(F.concat_ws("^", F.col("model_id").cast("string"), F.col("field_id").cast("string")))
        .alias("prefix"),
        F.col("field_type").isin(*RELATIONAL_TYPES).alias("is_foreign_key"),
        F.when(F.col("field_type").isin(*RELATIONAL_TYPES), strip_id_suffix(F.col("primary_data_location")))
        .alias("target_model"),
    )


def encoding_preview(catalog: DataFrame, model: str, n: int = 20) -> DataFrame:
    """Field count and the first ``n`` prefixes of a model, in catalog order."""
    emap = encoding_map(fields_of_model(catalog, model))
    count = fields_of_model(catalog, model).agg(F.count(F.lit(1))).scalar()
    first = emap.orderBy("line_no").limit(n)
    first = first.withColumn("position", F.row_number().over(Window.orderBy("line_no")))
    return first.select("model_name", "position", "field_name", "prefix", F.col("field_type").alias("type"),
                        count.alias("field_count"))


def coord_lookup(catalog: DataFrame) -> DataFrame:
    """One row per coordinate (Q1).

    Native coordinates always win, the last one in file order; a many2one
    target coordinate is used only when no native row has it, the first one
    in file order.
    """
    m2o = F.col("field_type") == "many2one"
    meta = [
        "field_name", "field_label", "field_type", "model_name", "model_id", "field_id", "line_no",
        m2o.alias("is_foreign_key"),
        F.when(m2o, strip_id_suffix(F.col("primary_data_location"))).alias("target_model"),
    ]
    native = catalog.select(
        F.concat_ws("^", F.col("model_id").cast("string"), F.col("field_id").cast("string")).alias("coordinate"),
        *meta, F.lit(False).alias("is_fk_entry"), (-F.col("line_no")).alias("prio"))
    fk = (catalog.filter(m2o & (F.col("primary_model_id") != "") & (F.col("primary_field_id") != ""))
          .select(F.concat_ws("^", "primary_model_id", "primary_field_id").alias("coordinate"),
                  *meta[:7], F.lit(True).alias("is_foreign_key"), meta[8],
                  F.lit(True).alias("is_fk_entry"), F.col("line_no").alias("prio")))
    w = Window.partitionBy("coordinate").orderBy("is_fk_entry", "prio")
    return (native.unionByName(fk).withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") == 1).drop("rn", "prio"))


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """A1: totals in one pass."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.countDistinct("model_name").alias("models"),
        F.count_if(F.col("stored")).alias("stored_count"),
        F.count_if(~F.col("stored")).alias("computed_count"),
    )


def type_counts(catalog: DataFrame, top: int | None = 10) -> DataFrame:
    """Fields per type, most frequent first (ties by type name)."""
    df = catalog.groupBy("field_type").agg(F.count(F.lit(1)).alias("n"))
    df = df.orderBy(F.desc("n"), "field_type")
    return df.limit(top) if top else df


def model_names(catalog: DataFrame) -> DataFrame:
    """A2: sorted distinct model names."""
    return catalog.select("model_name").distinct().orderBy("model_name")


def model_config(catalog: DataFrame) -> DataFrame:
    """Model id (first row), field id of ``id`` and field count per model.

    Models without an ``id`` row get ``status = 'no id field'`` instead of an
    exception, so all models are checked in one pass.
    """
    return (catalog.groupBy("model_name")
            .agg(F.min_by("model_id", "line_no").alias("model_id"),
                 F.expr("min_by(field_id, line_no) FILTER (WHERE field_name = 'id')").alias("id_field_id"),
                 F.count(F.lit(1)).alias("field_count"))
            .withColumn("status", F.when(F.col("id_field_id").isNull(), F.lit("no id field"))
                        .otherwise(F.lit("ok"))))


def name_suggestions(catalog: DataFrame, term: str, n: int = 5) -> DataFrame:
    """P10: up to ``n`` model names that contain the term or any dot-part of it."""
    t = term.lower()
    parts = [p for p in t.split(".")]
    name = F.lower(F.col("model_name"))
    cond = name.contains(t)
    for p in parts:
        cond = cond | name.contains(p)
    return model_names(catalog).filter(cond).orderBy("model_name").limit(n)


def column_alignment(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Record columns against the catalog of their model.

    ``columns`` has (model_name, field_name). Output: (model_name, field_name,
    status) with status matched / missing_in_schema / missing_in_source.
    """
    cat = catalog.select("model_name", "field_name").distinct()
    matched = columns.join(cat, ["model_name", "field_name"], "left_semi").withColumn("status", F.lit("matched"))
    missing_schema = (columns.join(cat, ["model_name", "field_name"], "left_anti")
                      .withColumn("status", F.lit("missing_in_schema")))
    models = columns.select("model_name").distinct()
    missing_source = (cat.join(models, "model_name", "left_semi")
                      .join(columns, ["model_name", "field_name"], "left_anti")
                      .withColumn("status", F.lit("missing_in_source")))
    return matched.unionByName(missing_schema).unionByName(missing_source)


def alignment_summary(alignment: DataFrame) -> DataFrame:
    """Per model, counts by status and ``valid`` (nothing missing in the catalog)."""
    return (alignment.groupBy("model_name")
            .agg(F.count_if(F.col("status") == "matched").alias("matched"),
                 F.count_if(F.col("status") == "missing_in_schema").alias("missing_in_schema"),
                 F.count_if(F.col("status") == "missing_in_source").alias("missing_in_source"))
            .withColumn("valid", F.col("missing_in_schema") == 0))


def fk_edges(catalog: DataFrame) -> DataFrame:
    """Model-to-model edges implied by many2one rows, with the field names."""
    return (catalog.filter(F.col("field_type") == "many2one")
            .select("model_name", strip_id_suffix(F.col("primary_data_location")).alias("target_model"),
                    "field_name")
            .groupBy("model_name", "target_model")
            .agg(F.count(F.lit(1)).alias("n_fields"),
                 F.array_join(F.array_sort(F.collect_list("field_name")), ",").alias("fields")))
