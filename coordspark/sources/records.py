"""Record scans (S4-S8) and state tables.

Records arrive as tables (Parquet, JDBC, JSON ...). A "domain" is a Spark
``Column`` predicate, so it reaches the scan as a pushed filter; the field
list is a projection, so only those columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


#: Fields of the fixed-shape lead scan (S6), in fetch order (fixed values).
LEAD_FIELDS = ("id", "name", "expected_revenue", "probability", "description", "create_date", "write_date",
               "date_closed", "city", "active", "partner_id", "stage_id", "user_id", "team_id", "state_id",
               "lost_reason_id", "x_specification_id", "x_lead_source_id", "x_architect_id")


def scan_records(records: DataFrame, domain: Column | None = None, fields: list[str] | None = None,
                 order: str | None = None, offset: int = 0, limit: int | None = None,
                 include_archived: bool = True, active_col: str = "active") -> DataFrame:
    """Filter (domain), project (fields), archived switch, optional order/offset/limit.

    ``include_archived=False`` keeps only active rows (the source default is
    to include them). Order, offset and limit apply only when asked: a full
    load is one partitioned scan, not pages.
    """
    df = records
    if not include_archived and active_col in df.columns:
        df = df.filter(F.col(active_col))
    if domain is not None:
        df = df.filter(domain)
    if fields:
        df = df.select(*fields)
    if order:
        df = df.orderBy(order)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df


def scan_all(records: DataFrame, test_limit: int | None = None, key: str = "id") -> DataFrame:
    """Every record; ``test_limit`` caps to the first N by key (a cap only when asked)."""
    return records.orderBy(key).limit(test_limit) if test_limit else records


def scan_leads(records: DataFrame) -> DataFrame:
    """Opportunities with the fixed lead field list, archived included."""
    present = [f for f in LEAD_FIELDS if f in records.columns]
    return records.filter(F.col("type") == "opportunity").select(*present)


def read_by_ids(records: DataFrame, ids: DataFrame | list[int], key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``: a literal ``isin`` for a short list,
    else a semi join (AQE broadcasts the ids if they are small)."""
    if isinstance(ids, list):
        return records.filter(F.col(key).isin(*ids))
    return records.join(ids.select(key), key, "left_semi")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one with the schema when it does not exist yet
    (a missing table means "start over"; any other error is the caller's to see,
    for an empty state would reload everything or lose the mark)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_state(df: DataFrame, path: str) -> str:
    """K4: write a state table version (callers use a fresh path per version)."""
    df.write.mode("overwrite").parquet(path)
    return path
