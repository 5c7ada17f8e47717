"""One search over catalog fields and records: embed, filter, rank, fetch, decode, report.

The plan materializes late. The first scan reads ids, vectors and the
filtered columns only and keeps the k best (TakeOrderedAndProject, k rows a
task); the payload of those k rows is then fetched by id, their encoded
strings are decoded to the key fields of their models, and the report columns
are made for k rows. What was shown goes back as usage rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import display_value, strip_id_suffix
from ..functions.text import score_percent
from .codec import DecodeTables, resolve_segments
from .vectors import DEFAULT_MIN_SCORE, cosine

#: Text of a record none of whose key fields can be decoded.
NO_KEY_FIELDS_TEXT = "*No decodable key fields found*"


def word_embed(text: Column, dim: int = 64) -> Column:
    """V7 (d): counts of the text's words by the first 16 bits of their md5, modulo ``dim``: an embedder
    made of SQL functions alone, so that any engine finds the same vectors."""
    # unlike split's, this pattern is compiled once, not once a row
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    at = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(dim)))

    def counts(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(a) - F.size(F.array_remove(a, i))).cast("float"))

    # a lambda over one array: its words are split and hashed once, not once for each of the dimensions
    return F.get(F.transform(F.array(at), counts), F.lit(0))


def best_ids(points: DataFrame, query: list[float], k: int, min_score: float, pred: Column | None = None) -> DataFrame:
    """``(id, score, rank)`` of the k best points above the threshold; reads ids, vectors and what ``pred`` names."""
    df = points if pred is None else points.filter(pred)
    scored = df.select("id", cosine(F.col("vector"), query).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k).filter(F.col("score") >= min_score)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def hits(points: DataFrame, query: list[float], tables: DecodeTables, key_fields: dict[str, list[str]], k: int = 10,
         min_score: float = DEFAULT_MIN_SCORE, pred: Column | None = None) -> DataFrame:
    """The k best points with their payload, and ``shown``: for records the decoded ``(field_name, line)`` of the
    key fields of their model (all fields where none are configured), in segment order."""
    found = F.broadcast(best_ids(points, query, k, min_score, pred))  # k rows
    rows = points.drop("vector").join(found, "id").withColumn("_data", F.coalesce(F.col("point_type") == "data", F.lit(False)))
    rows = rows.withColumn("encoded_string", F.when(F.col("_data"), F.col("encoded_string")))
    rows = resolve_segments(rows, tables)

    def shown(x: Column) -> Column:
        allowed = ~F.col("model_name").isin(*key_fields) if key_fields else F.lit(True)
        for m, fs in key_fields.items():
            allowed = allowed | ((F.col("model_name") == m) & x["entry"]["field_name"].isin(*fs))
        return x["entry"].isNotNull() & allowed

    def line(x: Column) -> Column:
        e = x["entry"]
        value = display_value(x["raw_value"], e["field_type"], e["target_model"])
        return F.struct(e["field_name"].alias("field_name"), F.concat(F.lit("- **"), e["field_label"], F.lit(":** "), value).alias("line"))

    return rows.withColumn("shown", F.transform(F.filter("segments", shown), line)).drop("segments")


def report(found: DataFrame) -> DataFrame:
    """One row per hit, best first: rank, kind, title, score, relation and details as text."""
    data, kind = F.col("_data"), F.col("field_type")
    title = F.when(data, F.concat("model_name", F.lit(" #"), F.col("record_id").cast("string"))) \
        .otherwise(F.concat_ws(".", "model_name", "field_name"))
    relation = F.when(~data & (kind == "many2one"), F.concat(F.lit("Relates to: "), strip_id_suffix(F.col("primary_data_location")))) \
        .when(~data & kind.isin("one2many", "many2many"), F.concat(F.lit("Related location: "), F.col("primary_data_location")))
    lines = F.array_join(F.transform("shown", lambda x: x["line"]), "\n")
    schema = F.concat_ws("\n", F.concat(F.lit("Label: "), F.col("field_label")), F.concat(F.lit("Type: "), kind),
                         F.concat(F.lit("Primary Data Location: "), F.col("primary_data_location")),
                         F.concat(F.lit("Stored: "), F.when(F.col("stored"), F.lit("Yes")).otherwise(F.lit("No (Computed)"))),
                         F.concat(F.lit("IDs: Model "), F.col("primary_model_id"), F.lit(" | Field "), F.col("primary_field_id")))
    details = F.when(data, F.when(F.size("shown") == 0, F.lit(NO_KEY_FIELDS_TEXT)).otherwise(lines)).otherwise(schema)
    return found.select("rank", "id",
                        F.when(data, F.lit("DATA")).otherwise(F.lit("SCHEMA")).alias("kind"), title.alias("title"),
                        score_percent(F.col("score")).alias("score_text"), relation.alias("relation"), details.alias("details"),
                        "encoded_string")


def usage_rows(found: DataFrame) -> DataFrame:
    """The fields that a search showed, one row each: ``(model_name, field_name, context)`` (input of A9)."""
    return found.select("model_name", F.explode("shown").alias("s")).select("model_name", "s.field_name", F.lit("decode").alias("context"))


def summary(found: DataFrame) -> DataFrame:
    """Head of a report: hits in all, of the catalog and of the records."""
    return found.agg(F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("_data")).alias("schema_hits"), F.count_if("_data").alias("data_hits"))
