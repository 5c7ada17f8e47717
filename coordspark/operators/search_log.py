"""Search analytics (X3) over a log of requests ``(ts, mode, latency_ms, results, score)``.

Per day and mode one row with counts, sums and a quantile sketch of the
latencies: small, mergeable and written once a day; any period's figures come
from merging its rows, without the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quantiles of a report.
QUANTILES = (0.5, 0.95, 0.99)
#: Size parameter of the KLL sketch (rank error about 1.3 % at 200, less for more).
SKETCH_K = 400


def daily(log: DataFrame) -> DataFrame:
    """``(day, mode, requests, zero, scored, score_sum, latency)`` with ``latency`` a sketch."""
    return (log.groupBy(F.to_date("ts").alias("day"), "mode")
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("results") == 0).alias("zero"),
                 F.count("score").alias("scored"), F.sum("score").alias("score_sum"),
                 F.kll_sketch_agg_double("latency_ms", F.lit(SKETCH_K)).alias("latency")))


def report(days: DataFrame, *by: str) -> DataFrame:
    """Figures of merged daily rows, per the columns ``by`` (of day, mode; none: over all)."""
    merged = days.groupBy(*by).agg(
        F.sum("requests").alias("requests"), F.sum("zero").alias("zero_results"), F.sum("scored").alias("scored"),
        F.sum("score_sum").alias("score_sum"), F.kll_merge_agg_double("latency", F.lit(SKETCH_K)).alias("latency"))
    quantiles = [F.kll_sketch_get_quantile_double("latency", F.lit(q)).alias(f"p{int(q * 100)}") for q in QUANTILES]
    return merged.select(*by, "requests", "zero_results", (F.col("zero_results") / F.col("requests")).alias("zero_rate"),
                         F.try_divide("score_sum", "scored").alias("mean_score"), *quantiles)


def exact_report(log: DataFrame, *by: str) -> DataFrame:
    """The same figures from the log itself, with exact quantiles: every latency of a group meets in
    one task, so this is for checks and small logs."""
    rows = log.withColumn("day", F.to_date("ts"))
    q = [F.percentile("latency_ms", q).alias(f"p{int(q * 100)}") for q in QUANTILES]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("results") == 0).alias("zero_results"),
                                 (F.count_if(F.col("results") == 0) / F.count(F.lit(1))).alias("zero_rate"),
                                 F.avg("score").alias("mean_score"), *q)
