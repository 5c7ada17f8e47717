"""Change detection and the incremental = full property."""

from pyspark.sql import functions as F

from coordspark.operators import changes as chg
from coordspark.plans import derived as dv

SF = "/root/testdata/sf0.01"


def test_expected_counts_sf001(spark):
    s = chg.change_summary(chg.detect_changes(dv.previous_snapshot(spark, SF), dv.current_snapshot(spark, SF))).first()
    assert (s.added, s.modified, s.deleted, s.unchanged) == (100, 128, 20, 772)
    assert s.summary == "100 added, 128 modified, 20 deleted"


def test_first_run_all_added_second_run_nothing(spark):
    cur = dv.current_snapshot(spark, SF)
    first = chg.detect_changes(None, cur)
    assert first.filter("change <> 'added'").count() == 0
    again = chg.change_summary(chg.detect_changes(cur, cur)).first()
    assert again.summary == "No changes detected" and again.unchanged == cur.count()


def test_one_edit_one_removal(spark):
    cur = dv.current_snapshot(spark, SF)
    edited = cur.withColumn("checksum", F.when(F.col("id") == 5, F.lit("x")).otherwise(F.col("checksum")))
    removed = edited.filter("id <> 7")
    s = chg.change_summary(chg.detect_changes(cur, removed)).first()
    assert (s.modified, s.deleted, s.added) == (1, 1, 0)


def test_incremental_equals_full(spark):
    prev, cur = dv.previous_snapshot(spark, SF), dv.current_snapshot(spark, SF)
    inc = chg.apply_changes(prev, cur, chg.detect_changes(prev, cur))
    assert inc.exceptAll(cur).count() == 0 and cur.exceptAll(inc).count() == 0


def test_snapshot_header_is_order_free(spark):
    cur = dv.current_snapshot(spark, SF)
    a = chg.snapshot_header(cur).first()
    b = chg.snapshot_header(cur.repartition(7).orderBy(F.rand(3))).first()
    assert a == b


def test_high_water_mark_strict_and_advances(spark):
    import datetime as dt
    ev = spark.read.parquet(f"{SF}/events.parquet")
    mark = dt.datetime(2024, 1, 15)
    rows = chg.incremental_rows(ev, mark, "ts")
    assert rows.filter(F.col("ts") <= F.lit(mark)).count() == 0
    st = chg.next_state(None, "events", rows, "ts").first()
    assert st.records_synced == 5332 and st.last_max_write_date == dt.datetime(2024, 1, 30, 23, 57, 12, 194062)
    # nothing new: success with 0 rows, the mark stays
    none = chg.incremental_rows(ev, st.last_max_write_date, "ts")
    st2 = chg.next_state(chg.next_state(None, "events", rows, "ts"), "events", none, "ts").first()
    assert st2.records_synced == 0 and st2.last_max_write_date == st.last_max_write_date
