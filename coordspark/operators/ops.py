"""Operational tables: failed rows, field usage and importance, sync-run
metrics, encoded/decoded pairs, restrictions by reason, token estimates and
repeated search requests.

All of them are logs (one row per event) aggregated with partial + final
hash aggregation; the "keep newest N" caps are global top-N sorts
(TakeOrderedAndProject) or per-key ``row_number`` windows, and apply only
when the caller names one: nothing is cut by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.codec import RESTRICTED_MARKER, SOURCE_ERROR_MARKER

# --- fixed values -------------------------------------------------------------------
MAX_FAILED_ROWS = 1_000        # failed-row table cap (for callers that ask for it)
MAX_USAGE_ENTRIES = 5_000      # usage table cap, by last use (likewise)
MAX_PAIRS = 10_000             # encoded/decoded pair cap (likewise)
# reasons of a restricted field
SECURITY_REASON = "security_restriction"
COMPUTE_REASON = "compute_error"
SOURCE_REASON = "odoo_error"
UNKNOWN_REASON = "unknown"
PROMOTION_THRESHOLD = 50.0     # importance score that promotes a field
MAX_KEY_FIELDS = 12            # configured + promoted key fields per model
SCORE_CAP = 50.0               # per-context score cap
SCORE_SCALE = 20.0             # log10(n + 1) * 20
MAX_PROMOTIONS_SHOWN = 5
MAX_WARNINGS = 100             # warnings of a run that are listed
TOP_FIELDS_SHOWN = 10
# -------------------------------------------------------------------------------------

FAILED_KEY = ["model_name", "record_id"]


def merge_failures(log: DataFrame, existing: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """K5: keyed upsert of failure events.

    ``log`` rows: record_id, model_name, model_id, failure_stage, error_message,
    batch_number, encoded_string, failed_at, seq (event order). Per key the
    newest event wins and retry_count = earlier events (+ existing count + 1
    if the key was already in ``existing``). All keys stay unless ``cap`` is
    given: then the newest ``cap`` keys by first failure (W2).
    """
    newest = F.max_by(F.struct("model_id", "failure_stage", "error_message", "batch_number",
                               "encoded_string", "failed_at"), F.col("seq"))
    agg = (log.groupBy(*FAILED_KEY)
           .agg(newest.alias("r"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
           .select(*FAILED_KEY, "r.*", (F.col("n") - 1).alias("retry_count"), "first_seq"))
    if existing is not None:
        ex = existing.select(*FAILED_KEY, F.col("retry_count").alias("old_retry"),
                             F.col("first_seq").alias("old_first"))
        agg = (agg.join(ex, FAILED_KEY, "left")
               .withColumn("retry_count", F.when(F.col("old_retry").isNotNull(),
                                                 F.col("old_retry") + F.col("retry_count") + 1)
                           .otherwise(F.col("retry_count")))
               .withColumn("first_seq", F.coalesce("old_first", "first_seq"))
               .drop("old_retry", "old_first"))
        kept = existing.join(agg.select(*FAILED_KEY), FAILED_KEY, "left_anti")
        agg = kept.unionByName(agg)
    if cap:
        agg = agg.orderBy(F.desc("first_seq"), *FAILED_KEY).limit(cap)
    return agg


def remove_failures(dlq: DataFrame, keys: DataFrame) -> DataFrame:
    """K6: drop keys that were retried successfully."""
    return dlq.join(keys.select(*FAILED_KEY), FAILED_KEY, "left_anti")


def clear_failures(dlq: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K6: clear one model (or all); returns (remaining, one-row count of cleared)."""
    remaining = dlq.filter(F.col("model_name") != model) if model else dlq.limit(0)
    gone = dlq.filter(F.col("model_name") == model) if model else dlq
    return remaining, gone.agg(F.count(F.lit(1)).alias("cleared"))


def failure_stats(dlq: DataFrame) -> DataFrame:
    """Total, by model and by stage in one pass (grouping sets)."""
    g = dlq.groupingSets([[], ["model_name"], ["failure_stage"]], "model_name", "failure_stage") \
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    level = (F.when(F.col("gid") == 3, F.lit("total")).when(F.col("gid") == 1, F.lit("model"))
             .otherwise(F.lit("stage")))
    key = F.when(F.col("gid") == 1, F.col("model_name")).when(F.col("gid") == 2, F.col("failure_stage"))
    return g.select(level.alias("level"), key.alias("key"), "n")


# --- usage and importance ---------------------------------------------------------------

def usage_counts(log: DataFrame) -> DataFrame:
    """Per (model, field) decode and search counts, first and last use.

    ``log`` rows: model_name, field_name, context ('decode' / 'search'), ts, seq.
    """
    return (log.groupBy("model_name", "field_name")
            .agg(F.count_if(F.col("context") == "decode").alias("decode_count"),
                 F.count_if(F.col("context") == "search").alias("search_count"),
                 F.max("ts").alias("last_used"),
                 F.min("seq").alias("first_seq")))


def cap_usage(usage: DataFrame, cap: int) -> DataFrame:
    """Keep the most recently used entries."""
    return usage.orderBy(F.desc("last_used"), "model_name", "field_name").limit(cap)


def js_round1(x: Column) -> Column:
    """Round to one decimal the way the source runtime does (half up)."""
    return F.floor(x * 10 + F.lit(0.5)) / 10


def _score(n: Column) -> Column:
    return F.least(F.lit(SCORE_CAP), F.log10(n.cast("double") + 1) * F.lit(SCORE_SCALE))


def field_importance(usage: DataFrame, key_fields: DataFrame) -> DataFrame:
    """A10: capped log scores, 1-decimal total, promoted if not a configured key
    field and the unrounded total reaches the threshold."""
    kf = F.broadcast(key_fields.select("model_name", "field_name", F.lit(True).alias("is_key")).distinct())
    raw = _score(F.col("decode_count")) + _score(F.col("search_count"))
    return (usage.join(kf, ["model_name", "field_name"], "left")
            .select("model_name", "field_name",
                    js_round1(raw).alias("total_score"),
                    F.col("decode_count").alias("decode_frequency"),
                    F.col("search_count").alias("search_frequency"),
                    (F.col("is_key").isNull() & (raw >= F.lit(PROMOTION_THRESHOLD))).alias("is_promoted"),
                    "first_seq"))


def adaptive_key_fields(importance: DataFrame, key_fields: DataFrame, models: list[str],
                        max_fields: int = MAX_KEY_FIELDS) -> DataFrame:
    """Configured key fields in order, then promoted fields by score
    (ties: first use), without repeats, at most ``max_fields`` per model.
    ``models`` is the (schema-sized) list of models to report."""
    conf = key_fields.select("model_name", "field_name", F.lit(0).alias("grp"),
                             F.col("key_rank").cast("double").alias("o1"), F.lit(0).cast("long").alias("o2"))
    prom = importance.filter("is_promoted").select(
        "model_name", "field_name", F.lit(1).alias("grp"), (-F.col("total_score")).alias("o1"),
        F.col("first_seq").cast("long").alias("o2"))
    both = conf.unionByName(prom).filter(F.col("model_name").isin(*models))
    w = Window.partitionBy("model_name").orderBy("grp", "o1", "o2", "field_name")
    return (both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_fields)
            .select("model_name", "rank", "field_name"))


def usage_summary(usage: DataFrame, importance: DataFrame) -> DataFrame:
    """Totals, top fields by use, first promotions, as (kind, rank, item, value) rows."""
    totals = usage.agg(F.sum("decode_count").alias("d"), F.sum("search_count").alias("s"))
    t1 = totals.select(F.lit("total_decodes").alias("kind"), F.lit(0).alias("rank"),
                       F.lit(None).cast("string").alias("item"), F.col("d").cast("double").alias("value"))
    t2 = totals.select(F.lit("total_searches").alias("kind"), F.lit(0).alias("rank"),
                       F.lit(None).cast("string").alias("item"), F.col("s").cast("double").alias("value"))
    use = F.col("decode_count") + F.col("search_count")
    top = (usage.withColumn("use", use)
           .orderBy(F.desc("use"), "first_seq").limit(TOP_FIELDS_SHOWN)
           .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("use"), "first_seq")))
           .select(F.lit("top_field").alias("kind"), "rank",
                   F.concat_ws(".", "model_name", "field_name").alias("item"), F.col("use").cast("double").alias("value")))
    # first use of each model, as a window (one group per model: schema-sized), no join
    model_seq = F.min("first_seq").over(Window.partitionBy("model_name"))
    prom = (importance.withColumn("model_seq", model_seq).filter("is_promoted")
            .orderBy("model_seq", F.desc("total_score"), "first_seq").limit(MAX_PROMOTIONS_SHOWN)
            .withColumn("rank", F.row_number().over(Window.orderBy("model_seq", F.desc("total_score"), "first_seq")))
            .select(F.lit("promotion").alias("kind"), "rank",
                    F.concat(F.col("model_name"), F.lit("."), F.col("field_name"), F.lit(" (score: "),
                             F.col("total_score").cast("string"), F.lit(")")).alias("item"),
                    F.col("total_score").alias("value")))
    return t1.unionByName(t2).unionByName(top).unionByName(prom)


def data_age(log: DataFrame, now: Column | None = None, ts_col: str = "ts") -> DataFrame:
    """Age of the usage data in hours (half up), from its first entry to ``now``; a row of the summary."""
    hours = (F.unix_micros((now if now is not None else F.current_timestamp()).cast("timestamp"))
             - F.unix_micros(F.min(F.col(ts_col).cast("timestamp")))) / F.lit(3.6e9)
    return log.agg(F.floor(hours + 0.5).cast("double").alias("value")).select(
        F.lit("age_hours").alias("kind"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("item"), "value")


# --- sync-run metrics (A8) -------------------------------------------------------------------

def duration_text(ms: Column) -> Column:
    """``850ms``, ``12.3s``, ``2m 5s``, ``1h 4m`` (integer arithmetic; tenths round half up)."""
    tenths = F.floor((ms + 50) / 100).cast("long")
    return (F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
            .when(ms < 60000, F.concat((tenths / 10).cast("long").cast("string"), F.lit("."),
                                       (tenths % 10).cast("string"), F.lit("s")))
            .when(ms < 3600000, F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "),
                                         F.floor((ms % 60000 + 500) / 1000).cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(ms / 3600000).cast("string"), F.lit("h "),
                                F.floor((ms % 3600000 + 30000) / 60000).cast("string"), F.lit("m"))))


def sync_run_metrics(runs: DataFrame) -> DataFrame:
    """Overall and per-model counters in one rollup.

    ``runs`` rows: model_name, success, records_processed, records_embedded,
    duration_ms, ts.
    """
    g = runs.rollup("model_name").agg(
        F.count(F.lit(1)).alias("syncs"),
        F.count_if("success").alias("successful_syncs"),
        F.sum("records_processed").alias("records_processed"),
        F.sum("records_embedded").alias("records_embedded"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.min("ts").alias("first_sync"), F.max("ts").alias("last_sync"),
        F.grouping_id().alias("gid"))
    failed = F.col("records_processed") - F.col("records_embedded")
    overall = F.col("gid") == 1
    rate_overall = F.floor(F.col("successful_syncs") * 100 / F.col("syncs") + 0.5)
    rate_model = (F.when(failed == 0, F.lit(100))
                  .otherwise(F.floor(F.col("records_embedded") * 100 / F.col("records_processed") + 0.5)))
    avg = F.floor(F.col("total_duration_ms") / F.col("syncs") + 0.5).cast("long")
    return g.select(
        F.when(overall, F.lit("overall")).otherwise(F.lit("model")).alias("level"),
        "model_name", "syncs", "successful_syncs", (F.col("syncs") - F.col("successful_syncs")).alias("failed_syncs"),
        "records_processed", "records_embedded", failed.alias("records_failed"), "total_duration_ms",
        avg.alias("avg_duration_ms"),
        F.when(overall, rate_overall).otherwise(rate_model).cast("long").alias("success_rate"),
        "first_sync", "last_sync",
        duration_text(F.when(overall, F.col("total_duration_ms")).otherwise(avg)).alias("duration_text"))


# --- pairs (K7, K8, A12, W2) ---------------------------------------------------------------

def pairs(decoded: DataFrame, ts: Column) -> DataFrame:
    """K8: (input, output, model_name, timestamp) from rows that carry both the
    encoded string and its decoded text; empty and "no fields" outputs skipped."""
    from ..functions.codec import NO_FIELDS_TEXT

    return (decoded.filter((F.coalesce(F.col("encoded_string"), F.lit("")) != "") &
                           (F.coalesce(F.col("decoded_text"), F.lit("")) != "") &
                           (F.col("decoded_text") != NO_FIELDS_TEXT))
            .select("record_id", F.col("encoded_string").alias("input"), F.col("decoded_text").alias("output"),
                    "model_name", ts.alias("timestamp")))


def keep_newest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """W2 (global): the newest ``n`` rows by ``order`` (descending keys given)."""
    return df.orderBy(*order).limit(n)


def pair_stats(p: DataFrame) -> DataFrame:
    """Total and per model count, oldest and newest (one rollup)."""
    g = p.rollup("model_name").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"),
                                   F.max("timestamp").alias("newest"), F.grouping_id().alias("gid"))
    return g.select(F.when(F.col("gid") == 1, F.lit("total")).otherwise(F.lit("model")).alias("level"),
                    "model_name", "n", "oldest", "newest")


def export_pairs(p: DataFrame, path: str) -> str:
    """K7: write the pairs as JSON lines."""
    p.select("input", "output", "model_name", "timestamp").write.mode("overwrite").json(path)
    return path


# --- restrictions, tokens, query keys --------------------------------------------------------

def classified_errors(errors: DataFrame) -> DataFrame:
    """E16 over an error log ``(error_id, message)``."""
    cols = tx.classify_error(F.col("message"))
    return errors.select("error_id", *[c.alias(k) for k, c in cols.items()])


def restrictions(classified: DataFrame) -> DataFrame:
    """(model_name, field_name, reason) from classified errors (I10 input):
    compute and security errors keep their own reason, a singleton error is the
    source's fault, anything else is unknown."""
    kind = F.col("error_type")
    reason = (F.when(kind == "compute_error", F.lit(COMPUTE_REASON))
              .when(kind == "security_restriction", F.lit(SECURITY_REASON))
              .when(kind == "singleton_error", F.lit(SOURCE_REASON))
              .otherwise(F.lit(UNKNOWN_REASON)))
    return (classified.filter(F.size("restricted_fields") > 0)
            .select(F.col("model").alias("model_name"), F.explode("restricted_fields").alias("field_name"),
                    reason.alias("reason"))
            .distinct())


def restrictions_by_reason(restr: DataFrame) -> DataFrame:
    """The restricted fields of each reason, one row per field (the list of a
    reason grows with the data, so it is rows, never one array) with the
    number of models it is restricted in."""
    return restr.groupBy("reason", "field_name").agg(F.countDistinct("model_name").alias("n_models"))


def run_warnings(restr: DataFrame, most: int = MAX_WARNINGS) -> DataFrame:
    """The warnings of a run, one per restricted field and reason, in order of model, field and
    reason; beyond ``most`` one closing line says that there are more (the limit is the report's)."""
    marker = F.when(F.col("reason") == SOURCE_REASON, F.lit(SOURCE_ERROR_MARKER)).otherwise(F.lit(RESTRICTED_MARKER))
    text = F.concat(F.lit("Field '"), F.col("field_name"), F.lit("' restricted ("), F.col("reason"), F.lit(") - marked as "), marker)
    first = restr.orderBy("model_name", "field_name", "reason").limit(most + 1)
    rank = F.row_number().over(Window.orderBy("model_name", "field_name", "reason"))  # most + 1 rows
    more = F.when(F.col("rank") > most, F.lit(f"... and more warnings (truncated at {most})")).otherwise(text)
    return first.withColumn("rank", rank).select("rank", F.when(F.col("rank") <= most, F.col("model_name")).alias("model_name"), more.alias("warning"))


def token_costs(docs: DataFrame, text_col: str, group_col: str, max_chars: int | None = None) -> DataFrame:
    """Per group the texts and their estimated tokens (whole texts, or their
    first ``max_chars`` characters, as an embedder with such a limit reads them)."""
    t = tx.token_estimate(tx.embed_input(F.col(text_col), max_chars))
    return docs.groupBy(group_col).agg(F.count(F.lit(1)).alias("texts"), F.sum(t).alias("tokens"))


def repeat_rate(queries: DataFrame, key: Column) -> DataFrame:
    """Share of requests whose key was seen before (1 - distinct / total)."""
    return queries.agg(F.count(F.lit(1)).alias("requests"), F.countDistinct(key).alias("distinct_keys")) \
        .withColumn("repeat_rate", F.round(1 - F.col("distinct_keys") / F.col("requests"), 6))
