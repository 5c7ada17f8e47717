"""Record scans (S4-S8) and state tables."""

from pyspark.sql import functions as F

from coordspark.session import scratch_path
from coordspark.sources import records as rec

SF = "/root/testdata/sf0.001"


def _leads(spark):
    rows = [(1, "a", "opportunity", True, 10.0), (2, "b", "lead", True, 5.0),
            (3, "c", "opportunity", False, 7.0), (4, "d", "opportunity", True, None)]
    return spark.createDataFrame(rows, "id long, name string, type string, active boolean, expected_revenue double")


def test_scan_domain_fields_archived_paging(spark):
    df = _leads(spark)
    got = rec.scan_records(df, F.col("type") == "opportunity", ["id", "name"], order="id", offset=1, limit=1,
                           include_archived=False)
    assert [tuple(r) for r in got.collect()] == [(4, "d")]
    assert rec.scan_records(df, include_archived=True).count() == 4


def test_scan_all_caps_only_when_asked(spark):
    df = _leads(spark)
    assert rec.scan_all(df).count() == 4
    assert [r.id for r in rec.scan_all(df, test_limit=2).collect()] == [1, 2]


def test_scan_leads_fixed_shape(spark):
    out = rec.scan_leads(_leads(spark))
    assert out.columns == ["id", "name", "expected_revenue", "active"] and out.count() == 3


def test_read_by_ids_list_and_frame(spark):
    df = _leads(spark)
    assert {r.id for r in rec.read_by_ids(df, [1, 3]).collect()} == {1, 3}
    ids = spark.createDataFrame([(2,), (4,), (4,)], "id long")
    assert {r.id for r in rec.read_by_ids(df, ids).collect()} == {2, 4}


def test_state_table_missing_is_empty_then_round_trips(spark):
    schema = "model_name string, last_max_write_date timestamp_ntz, records_synced long"
    path = scratch_path(spark, "state")
    assert rec.read_state(spark, path, schema).count() == 0
    st = spark.createDataFrame([("events", None, 3)], schema)
    rec.write_state(st, path)
    assert rec.read_state(spark, path, schema).first().records_synced == 3


def test_domain_reaches_scan(spark):
    from coordspark.plans import fixture as fx

    df = rec.scan_records(fx.read_table(spark, SF, "orders"), F.col("o_totalprice") > 1000.0,
                          ["o_orderkey", "o_totalprice"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
