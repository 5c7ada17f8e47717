"""Change handling between snapshots: checksums (E12), change detection (J4),
changed-row selection (J6), change summary (A14), snapshot header (A18),
applying a change set (K1 + K3, "incremental = full") and the high-water
mark incremental load (I1, A6, K4).

Snapshots are narrow ``(id, checksum)`` tables, so J4 is one full outer join
shuffled on the id; all later steps are semi / anti joins on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Modulus of the order-free digest sum (a prime below 2^61; the sum itself is
#: exact in DECIMAL(38,0), so no overflow at any table size).
DIGEST_MODULUS = 2**61 - 1


def snapshot(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, md5(text))`` per row."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.md5(text).alias("checksum"))


def detect_changes(previous: DataFrame | None, current: DataFrame) -> DataFrame:
    """``(id, change)`` with change in added / modified / deleted / unchanged.

    No previous snapshot: every current id is added. A NULL checksum (NULL
    text) is a value like any other: presence is told by a flag of its own.
    """
    if previous is None:
        return current.select("id", F.lit("added").alias("change"))
    p = previous.select("id", F.col("checksum").alias("prev"), F.lit(True).alias("in_prev"))
    c = current.select("id", F.col("checksum").alias("cur"), F.lit(True).alias("in_cur"))
    j = c.join(p, "id", "full_outer")
    change = (F.when(F.col("in_prev").isNull(), F.lit("added"))
              .when(F.col("in_cur").isNull(), F.lit("deleted"))
              .when(~F.col("cur").eqNullSafe(F.col("prev")), F.lit("modified"))
              .otherwise(F.lit("unchanged")))
    return j.select("id", change.alias("change"))


def changed_rows(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current rows that were added or modified."""
    ids = changes.filter(F.col("change").isin("added", "modified")).select("id")
    return current.join(ids, "id", "left_semi")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row of counts and the summary text ("3 added, 1 deleted")."""
    counts = changes.agg(*[F.count_if(F.col("change") == k).alias(k)
                           for k in ("added", "modified", "deleted", "unchanged")])
    parts = [F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(" " + k)))
             for k in ("added", "modified", "deleted")]
    text = F.when((F.col("added") + F.col("modified") + F.col("deleted")) == 0, F.lit("No changes detected")) \
        .otherwise(F.concat_ws(", ", *parts))
    return counts.withColumn("summary", text)


def _h60(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def snapshot_header(snap: DataFrame) -> DataFrame:
    """Row count and an order-free digest of a snapshot (sum modulo a prime
    and xor of the first 60 bits of md5(id:checksum), a NULL checksum as "id"); partial + final
    aggregation, no single-task concatenation of the table."""
    h = _h60(F.concat_ws(":", F.col("id").cast("string"), F.col("checksum")))
    return snap.agg(F.count(F.lit(1)).alias("total_rows"),
                    F.coalesce(F.pmod(F.sum(h.cast("decimal(38,0)")), F.lit(DIGEST_MODULUS).cast("decimal(38,0)")),
                               F.lit(0)).cast("long").alias("digest_sum"),
                    F.coalesce(F.bit_xor(h), F.lit(0)).cast("long").alias("digest_xor"))


def merge_snapshots(previous: DataFrame, current: DataFrame, checksum: str = "checksum") -> DataFrame:
    """J4 + K1 + K3 in one full outer join: the rows of ``current`` with their ``change``, where an
    unchanged row is the previous one (so what hangs on it, a vector say, needs no recomputing).
    Both sides have the same columns and are shuffled once."""
    cols = [c for c in previous.columns if c != "id"]
    p = previous.select("id", F.struct(*cols).alias("_old"))
    c = current.select("id", F.struct(*cols).alias("_new"))
    same = F.col(f"_new.{checksum}").eqNullSafe(F.col(f"_old.{checksum}"))
    change = F.when(F.col("_old").isNull(), F.lit("added")).when(same, F.lit("unchanged")).otherwise(F.lit("modified"))
    joined = p.join(c, "id", "full_outer").filter(F.col("_new").isNotNull()).withColumn("change", change)
    row = F.when(F.col("change") == "unchanged", F.col("_old")).otherwise(F.col("_new"))
    return joined.select("id", row.alias("_row"), "change").select("id", "_row.*", "change").select(*previous.columns, "change")


def apply_changes(previous: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """K1 + K3: previous table with added/modified rows upserted and deleted
    ids removed, in one anti join (the replaced and the deleted ids are one
    key set) plus a semi join for the fresh rows. Equals ``current`` when
    the change set is complete."""
    touched = changes.filter(F.col("change") != "unchanged").select("id")
    fresh = changed_rows(current, changes)
    return previous.join(touched, "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


# --- high-water mark (I1, A6, K4) ----------------------------------------------

def incremental_rows(records: DataFrame, mark, ts_col: str = "write_date",
                     force_full: bool = False) -> DataFrame:
    """Rows changed strictly after the mark (Q17); first run / force_full: all.

    The predicate is a plain comparison so it reaches the Parquet scan
    (PushedFilters) and row groups below the mark are skipped.
    """
    if mark is None or force_full:
        return records
    return records.filter(F.col(ts_col) > mark_literal(mark, dict(records.dtypes)[ts_col]))


def mark_literal(mark, col_type: str) -> Column:
    """The mark as a literal of the column's own type, built from text so that
    the session time zone never shifts it (a Python datetime literal is zoned)."""
    import datetime as _dt

    text = mark.isoformat(sep=" ") if isinstance(mark, _dt.datetime) else str(mark)
    target = "timestamp_ntz" if col_type == "timestamp_ntz" else ("timestamp" if col_type == "timestamp" else None)
    return F.lit(text).cast(target) if target else F.lit(mark)


def max_change_time(rows: DataFrame, ts_col: str = "write_date") -> DataFrame:
    """Rows loaded and their max change time (text values parsed, unparsable ignored)."""
    c = F.col(ts_col)
    is_text = dict(rows.dtypes)[ts_col] == "string"
    t = c.try_cast("timestamp_ntz") if is_text else c
    return rows.agg(F.count(F.lit(1)).alias("records_loaded"), F.max(t).alias("max_change_time"))


def next_state(state: DataFrame | None, model: str, loaded: DataFrame, ts_col: str = "write_date") -> DataFrame:
    """K4: high-water state keyed by model. The mark advances to the max over the
    rows actually loaded (Q17 fix); with nothing new it stays where it was.
    Old and new rows are merged by a keyed aggregate (no join)."""
    return merge_state(state, max_change_time(loaded, ts_col), model)


def merge_state(state: DataFrame | None, stats: DataFrame, model: str) -> DataFrame:
    """K4 from the counts of a run that are known already: ``stats`` is A6's row."""
    new = stats.select(F.lit(model).alias("model_name"), F.col("max_change_time").alias("last_max_write_date"),
                       F.col("records_loaded").alias("records_synced"), F.lit(1).alias("is_new"))
    if state is None:
        state = stats.sparkSession.createDataFrame(
            [], "model_name string, last_max_write_date timestamp_ntz, records_synced long")
    rows = state.select("model_name", "last_max_write_date", "records_synced", F.lit(0).alias("is_new"))
    both = rows.unionByName(new)
    return (both.groupBy("model_name")
            .agg(F.max("last_max_write_date").alias("last_max_write_date"),
                 F.max_by("records_synced", "is_new").alias("records_synced")))


# --- schema hash (I8) ---------------------------------------------------------------

def schema_hash(catalog: DataFrame) -> DataFrame:
    """I8: ``v1-<fields>-<models>``; usage state stored under another hash is stale."""
    return catalog.agg(F.concat(F.lit("v1-"), F.count(F.lit(1)).cast("string"), F.lit("-"),
                                F.countDistinct("model_name").cast("string")).alias("schema_hash"))


def state_for_schema(state: DataFrame, current_hash: DataFrame) -> DataFrame:
    """I8: keep only state rows written under the current schema hash (others are cleared)."""
    return state.join(F.broadcast(current_hash), "schema_hash", "left_semi")
