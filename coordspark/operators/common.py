"""Small shared helpers: size-checked broadcast and bounded collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    Beyond the bound the plain DataFrame is returned and Spark plans a
    shuffle join (sort-merge, or a runtime broadcast by AQE if it turns out
    small). The count runs on the small side only.
    """
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Collect a schema-sized frame to the driver, failing loudly above the bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work at least one task per core.

    A scan yields one task per file split; a small file (one row group) is
    one task however many cores there are. Below the default parallelism we
    repartition round-robin; at scale the scan already has many more
    partitions than cores and this is a no-op (no extra shuffle).
    """
    try:
        n = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # e.g. a Spark Connect session: no RDD view, keep the plan as is
        return df
    return df.repartition(n) if parts < n else df
