"""Catalog loads and sync runs: full load (I3), incremental load (I4) and the
run record (I9).

I4 in Spark terms: compare snapshot headers (A18; equal -> nothing to do),
else J4 on ``(id, md5(semantic_text))``, embed only added + modified (J6,
V7), upsert them and delete removed ids (K1 + K3). The result equals a full
rebuild ("incremental = full", tested).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import changes as chg
from . import points as pts


class CatalogLoad(NamedTuple):
    points: DataFrame        # the new point table (schema points)
    changes: DataFrame       # (id, change)
    summary: DataFrame       # one row: added, modified, deleted, unchanged, summary
    skipped: bool            # headers matched: nothing recomputed


def full_catalog_load(catalog: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Catalog -> semantic text -> vectors -> schema points (write with ``points.write_points``)."""
    return embed(pts.schema_points(catalog).drop("vector"))


def incremental_catalog_load(catalog: DataFrame, previous_points: DataFrame,
                             embed: Callable[[DataFrame], DataFrame], force_full: bool = False) -> CatalogLoad:
    """I4: only changed fields are embedded; removed fields are deleted."""
    cur_points = pts.schema_points(catalog).drop("vector")
    cur = chg.snapshot(cur_points, "id", F.col("semantic_text"))
    prev = chg.snapshot(previous_points, "id", F.col("semantic_text"))
    if force_full:
        new = full_catalog_load(catalog, embed)
        changes = chg.detect_changes(None, cur)
        return CatalogLoad(new, changes, chg.change_summary(changes), False)
    same = chg.snapshot_header(cur).collect()[0] == chg.snapshot_header(prev).collect()[0]
    if same:
        changes = prev.select("id", F.lit("unchanged").alias("change"))
        return CatalogLoad(previous_points, changes, chg.change_summary(changes), True)
    changes = chg.detect_changes(prev, cur)
    fresh = embed(chg.changed_rows(cur_points, changes))
    kept = previous_points.select(*fresh.columns)
    new = chg.apply_changes(kept, fresh, changes)
    return CatalogLoad(new, changes, chg.change_summary(changes), False)


def run_record(model: str, loaded: DataFrame, embedded: DataFrame, duration_ms: int) -> DataFrame:
    """One sync-run row (success = every loaded row was embedded)."""
    p = loaded.agg(F.count(F.lit(1)).alias("records_processed"))
    e = embedded.agg(F.count(F.lit(1))).scalar()
    return (p.withColumn("records_embedded", e)
            .select(F.lit(model).alias("model_name"),
                    (F.col("records_processed") == F.col("records_embedded")).alias("success"),
                    "records_processed", "records_embedded",
                    F.lit(int(duration_ms)).cast("long").alias("duration_ms"),
                    F.current_timestamp().alias("ts")))
