"""Search analytics: merged sketches against exact quantiles."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from coordspark.operators import search_log as slog
from coordspark.session import scratch_path


def test_merged_sketches_stay_in_their_rank_error(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    latency = rng.lognormal(4, 1.2, n)
    rows = [(dt.datetime(2024, 1, 1 + i % 20, i % 24), "ab"[i % 3 == 0], float(latency[i]), i % 7, float(i % 10) if i % 7 else None) for i in range(n)]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, mode string, latency_ms double, results int, score double")
    path = scratch_path(spark, "daily")
    slog.daily(log).write.parquet(path)   # a row per day and mode is all that is kept
    days = spark.read.parquet(path)
    assert days.count() == 40
    got = slog.report(days).first()
    assert got["requests"] == n and got["zero_results"] == sum(r[3] == 0 for r in rows)
    assert abs(got["mean_score"] - np.mean([r[4] for r in rows if r[4] is not None])) < 1e-9
    for q in slog.QUANTILES:
        low, high = np.quantile(latency, [q - 0.01, min(1, q + 0.01)])
        assert low <= got[f"p{int(q * 100)}"] <= high
    exact = {r["mode"]: r for r in slog.exact_report(log, "mode").collect()}
    for r in slog.report(days, "mode").collect():
        assert all(abs(r[c] - exact[r["mode"]][c]) < 1e-9 for c in ("requests", "zero_results", "zero_rate", "mean_score"))
    assert slog.report(days.filter(F.lit(False)), "mode").collect() == []
