"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then is timed with a full execution
(noop sink: every row produced, nothing collected to the driver).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "encode_orders",          # E1 over 150k orders (sf0.1)
    "decode_text_orders",     # E6 + J1 + E8 + E9 per record
    "decode_customer_key_fields",
    "decode_stats",           # A13 over every model's records
    "roundtrip_documents",    # encode + decode 10k long texts
    "knn_top10",              # V1 exact single query
    "knn_batch",              # V3 every vector a query
    "search_quality",         # A17
    "change_detection",       # J4 over documents
    "upsert_points",          # K1 + K3 incremental = full
    "highwater_increment",    # I1 with pushdown
    "stale_points",           # J5
    "dlq_upsert",             # K5
    "usage_counts",           # A9
    "field_importance",       # A10
    "sync_run_metrics",       # A8
    "keep_newest_n",          # K8 + W2
    "error_log_fields",       # E16
    "stream_usage_counts",    # I5 streaming = batch
    "stream_encode_orders",   # I2 record load: stream -> encode -> points (baseline: full record load)
    "full_catalog_load",      # I3 (baseline: full catalog load)
    "incremental_catalog_load",  # I4 (baseline: incremental catalog load)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from coordspark.plans.queries import QUERIES
    from coordspark.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="coordspark-bench")
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        fn = QUERIES.get(name)
        if fn is None:
            continue
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep going; report
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
