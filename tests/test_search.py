"""The composed search: late materialization, key fields, report and usage rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from coordspark.operators import catalog as cat
from coordspark.operators import codec
from coordspark.operators import points as pts
from coordspark.operators import search as srch
from coordspark.plans import fixture as fx
from coordspark.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    c = fx.catalog(spark, SF)
    plan = codec.encoding_plan(cat.encoding_map(c))
    enc = codec.encode_records(fx.record_view(spark, SF, "customer"), plan, "customer")
    both = pts.point_table(pts.schema_points(c), pts.data_points(enc))
    odd = both.filter("id = 30000001").withColumns({"id": F.lit(-5).cast("long"), "encoded_string": F.lit("junk customer"), "record_id": F.lit(None).cast("long")})
    both = both.unionByName(odd).withColumn("vector", srch.word_embed(F.coalesce("encoded_string", "semantic_text")))
    path = pts.write_points(both, scratch_path(spark, "search-test"))
    return spark.read.parquet(path), codec.DecodeTables(cat.coord_lookup(c), plan)


def _vector(spark, text):
    return [float(x) for x in spark.range(1).select(srch.word_embed(F.lit(text)).alias("v")).first()["v"]]


def test_first_scan_reads_ids_and_vectors_only(spark, world):
    points, tables = world
    found = srch.hits(points, _vector(spark, "customer building"), tables, {}, k=5, min_score=0.0, pred=pts.payload_filter(point_type="data"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert "TakeOrderedAndProject" in plan and any(s == "id:bigint,vector:array<float>" for s in schemas), schemas
    assert plan.count("FileScan parquet") == 2 and plan.count("vector:array<float>") == 1
    assert re.search(r"PartitionFilters: \[[^\]]*point_type#\d+ = data", plan)


def test_hits_key_fields_report_and_usage(spark, world):
    points, tables = world
    q = _vector(spark, "customer 1 building")
    found = srch.hits(points, q, tables, {"customer": ["c_name", "c_mktsegment"]}, k=8, min_score=0.0, pred=pts.payload_filter(point_type="data")).cache()
    rows = srch.report(found).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 8
    want = codec.decode_text(points.filter("id > 30000000").select("record_id", "model_name", "encoded_string"), tables, {"customer": ["c_name", "c_mktsegment"]})
    want = {f"customer #{r['record_id']}": r["decoded_text"] for r in want.collect()}
    assert all(r["kind"] == "DATA" and r["details"] == want.get(r["title"], srch.NO_KEY_FIELDS_TEXT) for r in rows)
    assert {r["field_name"] for r in srch.usage_rows(found).collect()} <= {"c_name", "c_mktsegment"}
    junk = srch.report(srch.hits(points, _vector(spark, "junk"), tables, {}, k=1, min_score=0.1)).first()
    assert junk["id"] == -5 and junk["details"] == srch.NO_KEY_FIELDS_TEXT


def test_schema_hits_and_no_hits(spark, world):
    points, tables = world
    found = srch.hits(points, _vector(spark, "nation references foreign key"), tables, {}, k=3, min_score=0.0, pred=pts.payload_filter(point_type="schema"))
    rows = srch.report(found).collect()
    assert {r["kind"] for r in rows} == {"SCHEMA"} and any((r["relation"] or "").startswith("Relates to: ") for r in rows)
    none = srch.hits(points, [0.0] * 64, tables, {}, k=3, min_score=0.5)
    assert srch.report(none).collect() == [] and srch.summary(none).first().asDict() == {"hits": 0, "schema_hits": 0, "data_hits": 0}


def test_word_embed_hashes_a_text_once_whatever_the_dimensions(spark):
    """The words were split and hashed again for each dimension."""
    df = spark.createDataFrame([(1, "b a b"), (2, "A-a"), (3, ""), (4, None)], "id int, t string")
    made = df.select("id", srch.word_embed(F.col("t"), 64).alias("v"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.rindex("md5") < plan.index("sequence(")  # not within the function of a dimension
    at = {w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in "ab"}
    want = {1: {at["a"]: 1, at["b"]: 2}, 2: {at["a"]: 2}, 3: {}}
    got = {r["id"]: r["v"] for r in made.collect()}
    assert {k: {i: x for i, x in enumerate(got[k]) if x} for k in want} == want
    assert got[4] == [None] * 64 and {len(v) for v in got.values()} == {64}


def test_word_embed_finds_words_with_a_pattern_compiled_once(spark):
    """Split compiled its pattern again for every text; the words are the same."""
    texts = ["", " ", "|", "Ab_1|c^2*Ab_1", "..x..", "é1ß_", "a\nb\x00c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string")
    made = df.select("id", srch.word_embed(F.col("t"), 16).alias("v"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" in plan and "split(" not in plan
    got = {r["id"]: r["v"] for r in made.collect()}
    for i, t in enumerate(texts):
        want = [0.0] * 16
        for w in re.findall("[a-z0-9_]+", t.lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16] += 1
        assert got[i] == want
    assert got[len(texts)] == [None] * 16
