"""Operational tables: failed rows, usage, importance, durations, error texts."""

from pyspark.sql import functions as F

from coordspark.functions.text import classify_error
from coordspark.operators import ops
from coordspark.plans import derived as dv
from coordspark.plans import fixture as fx

SF = "/root/testdata/sf0.01"


def test_failure_log_expected(spark):
    log = dv.failure_log(spark, SF).filter("model_name = 'events'")
    d = ops.merge_failures(log, cap=None)
    assert d.count() == 150 and d.agg(F.sum("retry_count")).first()[0] == 1864


def test_failure_merge_with_existing(spark):
    log = dv.failure_log(spark, SF).filter("model_name = 'events'")
    first = ops.merge_failures(log.filter("seq < 5000"), cap=None)
    both = ops.merge_failures(log.filter("seq >= 5000"), existing=first, cap=None)
    once = ops.merge_failures(log, cap=None)
    cols = ["model_name", "record_id", "retry_count", "failure_stage", "first_seq"]
    assert both.select(cols).exceptAll(once.select(cols)).count() == 0


def test_usage_expected(spark):
    u = ops.usage_counts(dv.usage_log(spark, SF))
    imp = ops.field_importance(u, fx.key_fields(spark))
    assert u.count() == 100 and imp.filter("is_promoted").count() == 80
    mn, mx = imp.agg(F.min("total_score"), F.max("total_score")).first()
    assert (round(mn, 1), round(mx, 1)) == (43.8, 58.8)


def test_promotion_threshold_316(spark):
    df = spark.createDataFrame([("m", "a", 316, 0, 1), ("m", "b", 315, 0, 2)],
                               "model_name string, field_name string, decode_count long, search_count long, first_seq long")
    imp = {r.field_name: r for r in ops.field_importance(df, fx.key_fields(spark)).collect()}
    assert imp["a"].is_promoted and not imp["b"].is_promoted    # Q21


def test_duration_text(spark):
    df = spark.createDataFrame([(850,), (12340,), (125000,), (3840000,)], "ms long")
    assert [r[0] for r in df.select(ops.duration_text(F.col("ms"))).collect()] == ["850ms", "12.3s", "2m 5s", "1h 4m"]


def test_classify_error_shapes(spark):
    msgs = [
        (1, "The requested operation can not be completed due to security restrictions.\nDocument type: Contact "
            "(res.partner)\nOperation: read\nUser: 78\nFields:\n- slide_channel_count (allowed for groups 'x')\n"
            "- slide_channel_ids (allowed for groups 'x')"),
        (2, "ValueError: Compute method failed to assign product.template(6952,).po_ids"),
        (3, "Access Denied by record rules for model 'res.partner', fields: [a, b]"),
        (4, "ValueError: Expected singleton: res.partner(1, 2, 4)"),
        (5, "something else"),
    ]
    df = spark.createDataFrame(msgs, "error_id long, message string")
    c = classify_error(F.col("message"))
    got = {r.error_id: r for r in df.select("error_id", *[v.alias(k) for k, v in c.items()]).collect()}
    assert got[1].error_type == "security_restriction" and got[1].model == "res.partner"
    assert got[1].operation == "read" and got[1].restricted_fields == ["slide_channel_count", "slide_channel_ids"]
    assert got[2].error_type == "compute_error" and got[2].restricted_fields == ["po_ids"]
    assert got[3].error_type == "security_restriction" and got[3].restricted_fields == ["a", "b"]
    assert got[4].error_type == "singleton_error" and got[4].model == "res.partner" and got[4].is_singleton
    assert got[5].error_type == "unknown" and not got[5].is_restriction


def test_export_pairs_round_trip(spark):
    import datetime as dt

    from coordspark.session import scratch_path

    p = spark.createDataFrame([(1, "3^301*1", "- **id:** 1", "customer", dt.datetime(2024, 1, 1))],
                              "record_id long, input string, output string, model_name string, timestamp timestamp_ntz")
    path = ops.export_pairs(p, scratch_path(spark, "pairs"))
    back = spark.read.json(path).collect()
    assert len(back) == 1 and back[0]["input"] == "3^301*1" and back[0]["output"] == "- **id:** 1"


def test_run_record(spark):
    from coordspark.operators.sync import run_record

    loaded = spark.range(5)
    r = run_record("orders", loaded, loaded.filter("id < 4"), 1234).first()
    assert (r.records_processed, r.records_embedded, r.success, r.duration_ms) == (5, 4, False, 1234)


def test_state_for_schema_drops_other_hashes(spark):
    from coordspark.operators.changes import schema_hash, state_for_schema

    cat = fx.catalog(spark, "/root/testdata/sf0.001")
    h = schema_hash(cat).first().schema_hash
    assert h == "v1-65-14"
    state = spark.createDataFrame([(h, "a"), ("v1-1-1", "b")], "schema_hash string, field_name string")
    assert [r.field_name for r in state_for_schema(state, schema_hash(cat)).collect()] == ["a"]
