"""The point table: catalog fields and encoded records with their vectors in
one wide table, discriminated by ``point_type``; filters, scrolls, the
catalog query modes (list, references out / in), counts, stale-row
detection and keyed writes.

The table is one flat schema (no payload union) so that every payload
filter is a plain column predicate that reaches the Parquet scan, and the
``vector`` column is read only by searches. Stored tables are partitioned by
``point_type`` so schema-only queries skip the data files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import RELATIONAL_TYPES
from ..functions.text import semantic_text

#: Point id of a record: model_id * 10,000,000 + record_id (fixed value).
MODEL_ID_MULTIPLIER = 10_000_000
#: Records outside 0 .. 9,999,999 get negative ids, this many to a model.
WIDE_MULTIPLIER = 1 << 42

POINT_COLUMNS = (
    "id", "point_type", "vector", "model_id", "model_name", "field_id", "field_name", "field_label",
    "field_type", "primary_data_location", "primary_model_id", "primary_field_id", "stored",
    "semantic_text", "raw_encoded", "record_id", "encoded_string", "field_count", "sync_timestamp",
)


def data_point_id(model_id: Column, record_id: Column) -> Column:
    """BIGINT point id of a record, one to one on (model_id, record_id).

    A record id that does not fit the scheme's 10,000,000 places gets a negative
    id of its own instead of another model's. NULL only where even that can't
    tell records apart (ids from 2^41 on, models from 2^20 on, NULLs).
    """
    m, r = model_id.cast("long"), record_id.cast("long")
    wide = F.when(r >= 0, F.shiftleft(r, 1)).otherwise(-F.shiftleft(r + 1, 1) + 1)
    top = F.lit(WIDE_MULTIPLIER // 2)
    return (F.when(r.between(0, MODEL_ID_MULTIPLIER - 1), m * F.lit(MODEL_ID_MULTIPLIER) + r)
            .when((r < top) & (r >= -top) & m.between(0, (1 << 20) - 1),
                  -(m * F.lit(WIDE_MULTIPLIER) + wide) - 1))


def schema_points(catalog: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """K9 (schema payload): one point per catalog field, id = field_id.

    ``vectors`` (id, vector) is joined by id; without it the vector is NULL.
    """
    pts = catalog.select(
        F.col("field_id").cast("long").alias("id"), F.lit("schema").alias("point_type"),
        "model_id", "model_name", "field_id", "field_name", "field_label", "field_type",
        "primary_data_location", "primary_model_id", "primary_field_id", "stored",
        semantic_text().alias("semantic_text"), F.col("raw_encoded"))
    return _attach(pts, vectors)


def data_points(encoded: DataFrame, vectors: DataFrame | None = None,
                sync_ts: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """K9 (data payload): one point per encoded record, id by E10 (``keep``: more columns to carry)."""
    pts = encoded.select(
        data_point_id(F.col("model_id"), F.col("record_id")).alias("id"), F.lit("data").alias("point_type"),
        "model_id", "model_name", "record_id", "encoded_string", "field_count",
        (sync_ts if sync_ts is not None else F.current_timestamp()).alias("sync_timestamp"), *keep)
    return _attach(pts, vectors)


def _attach(pts: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Vectors joined by id (a missing vector stays NULL, nothing shifts)."""
    if vectors is None:
        return pts.withColumn("vector", F.lit(None).cast("array<float>"))
    return pts.join(vectors.select("id", "vector"), "id", "left")


def point_table(*parts: DataFrame) -> DataFrame:
    """Union of schema and data points on the full point schema."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = [c for c in POINT_COLUMNS if c not in df.columns]
    for c in missing:
        df = df.withColumn(c, F.lit(None))
    return df.select(*POINT_COLUMNS)


def point_type_filter(point_type: str | None) -> Column | None:
    """``data``; ``schema`` = not data (NULL counts as schema); ``all`` = none."""
    if point_type in (None, "all"):
        return None
    if point_type == "data":
        return F.col("point_type") == "data"
    return F.coalesce(F.col("point_type"), F.lit("schema")) != "data"


def payload_filter(model_name: str | None = None, field_type: str | list[str] | None = None,
                   location_model: str | None = None, stored_only: bool = False,
                   point_type: str | None = "schema") -> Column:
    """P1 + P2: AND of the given conditions (TRUE if none)."""
    conds: list[Column] = []
    if model_name:
        conds.append(F.col("model_name") == F.lit(model_name))
    if field_type:
        if isinstance(field_type, (list, tuple)):
            conds.append(F.col("field_type").isin(*field_type))
        else:
            conds.append(F.col("field_type") == F.lit(field_type))
    if location_model:
        # Q10: called a prefix, matched exactly on "<model>.id".
        conds.append(F.col("primary_data_location") == F.lit(location_model + ".id"))
    if stored_only:
        conds.append(F.col("stored") == F.lit(True))
    pt = point_type_filter(point_type)
    if pt is not None:
        conds.append(pt)
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def scroll(points: DataFrame, pred: Column, limit: int | None = 100) -> DataFrame:
    """Filter-only read in id order, no vector, score 1.0."""
    df = points.filter(pred).drop("vector").withColumn("score", F.lit(1.0)).orderBy("id")
    return df.limit(limit) if limit else df


def list_fields(points: DataFrame, model: str, field_types: list[str] | None = None,
                stored_only: bool = False, limit: int | None = None) -> DataFrame:
    """Catalog points of a model (Q12 fix: schema points only)."""
    return scroll(points, payload_filter(model, field_types, None, stored_only, "schema"), limit)


def references_out(points: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """P5: relational fields of a model (type and stored filters do not apply, Q11)."""
    return scroll(points, payload_filter(model, list(RELATIONAL_TYPES), None, False, "schema"), limit)


def references_in(points: DataFrame, target: str, limit: int | None = None) -> DataFrame:
    """many2one fields of any model whose location is ``target.id``."""
    return scroll(points, payload_filter(None, "many2one", target, False, "schema"), limit)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """A3: counts per key, most frequent first, with the sorted field names."""
    return (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.array_join(F.array_sort(F.collect_list("field_name")), ",").alias("fields"))
            .orderBy(F.desc("n"), key))


def filtered_count(df: DataFrame, pred: Column | None = None) -> DataFrame:
    """A4: number of rows matching a predicate, as a one-row frame."""
    return (df.filter(pred) if pred is not None else df).agg(F.count(F.lit(1)).alias("n"))


def point_counts(points: DataFrame) -> DataFrame:
    """A5: total, data and schema (= total - data) points in one pass."""
    is_data = F.coalesce(F.col("point_type"), F.lit("schema")) == "data"
    return points.agg(F.count(F.lit(1)).alias("total_points"),
                      F.count_if(is_data).alias("data_points"),
                      F.count_if(~is_data).alias("schema_points"))


def stale_points(points: DataFrame, model: str, source_ids: DataFrame) -> DataFrame:
    """Data points of ``model`` whose record id is gone from the source.

    ``source_ids`` needs only the ``id`` column (column pruning keeps the
    source scan to one column); a left anti join, shuffled on the id.
    """
    pts = points.filter((F.col("point_type") == "data") & (F.col("model_name") == model))
    src = source_ids.select(F.col("id").cast("long").alias("record_id"))
    return pts.join(src, "record_id", "left_anti").select("id", "record_id", "model_name")


def merge(old: DataFrame | None, new: DataFrame, key: str = "id", order: str | None = None, gone: Column | None = None) -> DataFrame:
    """K1 + K3 in one full outer join on the key: a new row replaces the old one or is
    added. With ``order`` only a row that isn't older by that column replaces;
    new rows for which ``gone`` is true remove their key instead.

    ``new`` holds one row per key. Both sides are shuffled once.
    """
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    if old is None:
        return new.filter(~gone)
    cols = [c for c in old.columns if c != key]
    extra = [F.lit(None).cast(old.schema[c].dataType).alias(c) if c not in new.columns else F.col(c).cast(old.schema[c].dataType).alias(c)
             for c in cols]
    o = old.select(key, F.struct(*cols).alias("_old"))
    n = new.select(key, F.struct(*extra).alias("_new"), gone.alias("_gone"))
    takes = F.col("_new").isNotNull()
    if order:
        takes = takes & F.coalesce(F.col(f"_new.{order}") >= F.col(f"_old.{order}"), F.lit(True))
    row = F.when(takes, F.col("_new")).otherwise(F.col("_old"))
    joined = o.join(n, key, "full_outer").filter(~(takes & F.coalesce(F.col("_gone"), F.lit(False))))
    return joined.select(key, row.alias("_row")).select(key, "_row.*").select(*old.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """K1: replace-or-insert by key (the new row wins)."""
    return merge(old, new, key)


def delete_ids(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """K3: remove rows whose key is in ``ids``."""
    return old.join(ids.select(key), key, "left_anti")


def page(records: DataFrame, offset: int, limit: int, order: str = "id") -> DataFrame:
    """Stable paging in key order."""
    return records.orderBy(order).offset(offset).limit(limit)


def write_points(points: DataFrame, path: str) -> str:
    """K2 / K1 sink: write a new version of the table (partitioned by point_type).

    Never overwrite the path being read: callers write to a fresh path and
    then switch readers to it (versioned paths in the shared folder).
    """
    points.write.mode("overwrite").partitionBy("point_type").parquet(path)
    return path
