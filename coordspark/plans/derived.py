"""Inputs derived from the driver tables for the change, failure, usage,
run-metrics, error and query-log operators. Each has a Spark builder and
the same derivation as a DuckDB CTE, so both sides read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixture as fx

# --- fixed values (derivation rules) ------------------------------------------------
HIGH_WATER_MARK = "2024-01-15 00:00:00"
STALE_EVERY = 20          # customers with key % 20 = 0 are gone from the source
SYNC_DATES = ("1997-03-01 00:00:00", "1999-06-01 00:00:00")  # source as of the first and the second sync run
STAGES = ("encoding", "embedding", "upsert")
# ---------------------------------------------------------------------------------------


def current_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5("text").alias("checksum"))


def previous_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as they were: every tenth missing (added since), every seventh
    with other text (modified since), and ids that no longer exist (deleted)."""
    d = fx.read_table(spark, sf, "documents")
    kept = d.filter(F.col("doc_id") % 10 != 0).select(
        F.col("doc_id").alias("id"),
        F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("checksum"))
    gone = d.filter(F.col("doc_id") % 50 == 1).select(
        (F.col("doc_id") + 1_000_000).alias("id"), F.md5("text").alias("checksum"))
    return kept.unionByName(gone)


CURRENT_SNAPSHOT_SQL = "cur AS (SELECT doc_id AS id, md5(text) AS checksum FROM documents)"
PREVIOUS_SNAPSHOT_SQL = """prev AS (
  SELECT doc_id AS id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS checksum
  FROM documents WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT doc_id + 1000000, md5(text) FROM documents WHERE doc_id % 50 = 1)"""


def failure_log(spark: SparkSession, sf: str) -> DataFrame:
    """Failed-row events: error events (key user_id) and pending orders (key order)."""
    e = fx.read_table(spark, sf, "events").filter(F.col("event_type") == "error")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 3 + 1).cast("int"))
    ev = e.select(
        F.col("user_id").alias("record_id"), F.lit("events").alias("model_name"),
        F.lit(fx.MODEL_IDS["events"]).alias("model_id"), stage.alias("failure_stage"),
        F.col("props").alias("error_message"), (F.col("event_id") / 500).cast("int").alias("batch_number"),
        F.lit("").alias("encoded_string"), F.col("ts").alias("failed_at"), F.col("event_id").alias("seq"))
    o = fx.read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    od = o.select(
        F.col("o_orderkey").alias("record_id"), F.lit("orders").alias("model_name"),
        F.lit(fx.MODEL_IDS["orders"]).alias("model_id"), F.lit("embedding").alias("failure_stage"),
        F.col("o_orderpriority").alias("error_message"), (F.col("o_orderkey") / 500).cast("int").alias("batch_number"),
        F.lit("").alias("encoded_string"), F.col("o_orderdate").alias("failed_at"),
        (F.col("o_orderkey") + 1_000_000_000).alias("seq"))
    return ev.unionByName(od)


FAILURE_LOG_SQL = """flog AS (
  SELECT user_id AS record_id, 'events' AS model_name, 8 AS model_id,
    ['encoding', 'embedding', 'upsert'][CAST(event_id % 3 AS INTEGER) + 1] AS failure_stage,
    props AS error_message, CAST(trunc(event_id / 500) AS INTEGER) AS batch_number, '' AS encoded_string,
    ts AS failed_at, event_id AS seq
  FROM events WHERE event_type = 'error'
  UNION ALL
  SELECT o_orderkey, 'orders', 6, 'embedding', o_orderpriority, CAST(trunc(o_orderkey / 500) AS INTEGER), '',
    o_orderdate, o_orderkey + 1000000000
  FROM orders WHERE o_orderstatus = 'P')"""


def usage_log(spark: SparkSession, sf: str) -> DataFrame:
    """Usage events: a view is a decode, a click a search; the field is ``k`` of props."""
    e = fx.read_table(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    return e.select(F.lit("events").alias("model_name"),
                    F.get_json_object("props", "$.k").alias("field_name"),
                    F.when(F.col("event_type") == "view", F.lit("decode")).otherwise(F.lit("search")).alias("context"),
                    "ts", F.col("event_id").alias("seq"))


USAGE_LOG_SQL = """ulog AS (
  SELECT 'events' AS model_name, json_extract_string(props, '$.k') AS field_name,
    CASE WHEN event_type = 'view' THEN 'decode' ELSE 'search' END AS context, ts, event_id AS seq
  FROM events WHERE event_type IN ('view', 'click'))"""


def sync_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per (event_type, day): processed = events, embedded = value >= 5,
    success = all embedded, duration = sum of value seconds (exact in ms)."""
    e = fx.read_table(spark, sf, "events")
    g = (e.groupBy("event_type", F.to_date("ts").alias("day"))
         .agg(F.count(F.lit(1)).alias("records_processed"),
              F.count_if(F.col("value") >= 5).alias("records_embedded"),
              (F.sum(F.round(F.col("value") * 100).cast("long")) * 10).alias("duration_ms"),
              F.max("ts").alias("ts")))
    return g.select(F.col("event_type").alias("model_name"),
                    (F.col("records_processed") == F.col("records_embedded")).alias("success"),
                    "records_processed", "records_embedded", "duration_ms", "ts")


SYNC_RUNS_SQL = """runs AS (
  SELECT event_type AS model_name, count(*) = count(*) FILTER (WHERE value >= 5) AS success,
    count(*) AS records_processed, count(*) FILTER (WHERE value >= 5) AS records_embedded,
    sum(CAST(round(value * 100) AS BIGINT)) * 10 AS duration_ms, max(ts) AS ts
  FROM events GROUP BY event_type, CAST(ts AS DATE))"""


def error_log(spark: SparkSession, sf: str) -> DataFrame:
    """Source error texts built from error events, five shapes by event id."""
    e = fx.read_table(spark, sf, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 5
    msg = (F.when(kind == 0, F.concat(
        F.lit("The requested operation can not be completed due to security restrictions.\n"
              "Document type: Event (events)\nOperation: read\nUser: "), F.col("user_id").cast("string"),
        F.lit("\nFields:\n- props (allowed for groups 'Analytics / Officer')\n- u_"),
        F.col("user_id").cast("string"), F.lit(" (allowed for groups 'Analytics / Officer')")))
        .when(kind == 1, F.concat(F.lit("ValueError: Compute method failed to assign events("),
                                  F.col("event_id").cast("string"), F.lit(",).value")))
        .when(kind == 2, F.concat(F.lit("Access Denied by record rules for model 'events', fields: [k_"), k,
                                  F.lit(", u_"), F.col("user_id").cast("string"), F.lit("]")))
        .when(kind == 3, F.concat(F.lit("ValueError: Expected singleton: events("),
                                  F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"),
                                  F.lit(")\nField 'event_type' cannot be computed")))
        .otherwise(F.concat(F.lit("Timeout after "), F.col("value").cast("string"), F.lit(" s"))))
    return e.select(F.col("event_id").alias("error_id"), msg.alias("message"))


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", F.col("text").alias("query"))


ERROR_LOG_SQL = """elog AS (
  SELECT event_id AS error_id, CASE event_id % 5
    WHEN 0 THEN 'The requested operation can not be completed due to security restrictions.' || chr(10) ||
      'Document type: Event (events)' || chr(10) || 'Operation: read' || chr(10) || 'User: ' || CAST(user_id AS VARCHAR) ||
      chr(10) || 'Fields:' || chr(10) || '- props (allowed for groups ''Analytics / Officer'')' || chr(10) || '- u_' ||
      CAST(user_id AS VARCHAR) || ' (allowed for groups ''Analytics / Officer'')'
    WHEN 1 THEN 'ValueError: Compute method failed to assign events(' || CAST(event_id AS VARCHAR) || ',).value'
    WHEN 2 THEN 'Access Denied by record rules for model ''events'', fields: [k_' || json_extract_string(props, '$.k') ||
      ', u_' || CAST(user_id AS VARCHAR) || ']'
    WHEN 3 THEN 'ValueError: Expected singleton: events(' || CAST(event_id AS VARCHAR) || ', ' || CAST(user_id AS VARCHAR) || ')' ||
      chr(10) || 'Field ''event_type'' cannot be computed'
    ELSE 'Timeout after ' || CAST(value AS VARCHAR) || ' s' END AS message
  FROM events WHERE event_type = 'error')"""


def usage_from_events(events: DataFrame) -> DataFrame:
    """Usage log from an events frame (batch or stream)."""
    e = events.filter(F.col("event_type").isin("view", "click"))
    return e.select(F.lit("events").alias("model_name"),
                    F.get_json_object("props", "$.k").alias("field_name"),
                    F.when(F.col("event_type") == "view", F.lit("decode")).otherwise(F.lit("search")).alias("context"),
                    "ts", F.col("event_id").alias("seq"))


def failures_from_events(events: DataFrame) -> DataFrame:
    """Failed-row log from an events frame (batch or stream)."""
    e = events.filter(F.col("event_type") == "error")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("record_id"), F.lit("events").alias("model_name"),
        F.lit(fx.MODEL_IDS["events"]).alias("model_id"), stage.alias("failure_stage"),
        F.col("props").alias("error_message"), (F.col("event_id") / 500).cast("int").alias("batch_number"),
        F.lit("").alias("encoded_string"), F.col("ts").alias("failed_at"), F.col("event_id").alias("seq"))


def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of search requests from events: the event type is the mode, its value the latency; a
    user in four finds nothing and has no score."""
    e = fx.read_table(spark, sf, "events")
    results = F.col("user_id") % 4
    return e.select("ts", F.col("event_type").alias("mode"), F.col("value").alias("latency_ms"), results.alias("results"),
                    F.when(results > 0, (F.col("event_id") % 100) / 100).alias("score"))


SEARCH_LOG_SQL = """slog AS (
  SELECT ts, event_type AS mode, value AS latency_ms, user_id % 4 AS results,
    CASE WHEN user_id % 4 > 0 THEN (event_id % 100) / 100 END AS score FROM events)"""
