"""Encode / decode unit tests: each type branch of E3 and E8, and the quirks."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coordspark.functions.codec import display_value, js_rtrim
from coordspark.operators import catalog as cat
from coordspark.operators import codec
from coordspark.sources.catalog_text import parse_catalog

LINES = [
    # model 10 "m.a": id, name, amount, flag, when, partner (many2one to m.p), tags
    "4^58*10|4^58*1001|4^26*id|4^33*ID|4^35*integer|4^28*m.a|4^60000*m.a.id|4^57*Yes|4^60001*10^1001*",
    "4^58*10|4^58*1002|4^26*name|4^33*Name|4^35*char|4^28*m.a|4^60000*m.a.name|4^57*Yes|4^60001*10^1002*",
    "4^58*10|4^58*1003|4^26*amount|4^33*Amount|4^35*monetary|4^28*m.a|4^60000*m.a.amount|4^57*Yes|4^60001*10^1003*",
    "4^58*10|4^58*1004|4^26*flag|4^33*Flag|4^35*boolean|4^28*m.a|4^60000*m.a.flag|4^57*Yes|4^60001*10^1004*",
    "4^58*10|4^58*1005|4^26*when|4^33*When|4^35*datetime|4^28*m.a|4^60000*m.a.when|4^57*Yes|4^60001*10^1005*",
    "4^58*10|4^58*1006|4^26*partner_id|4^33*Partner|4^35*many2one|4^28*m.a|4^60000*m.p.id|4^57*Yes|4^60001*20^2001*",
    "4^58*10|4^58*1007|4^26*tag_ids|4^33*Tags|4^35*many2many|4^28*m.a|4^60000*m.t.id|4^57*No|4^60001*",
    "4^58*10|4^58*1008|4^26*ratio|4^33*Ratio|4^35*float|4^28*m.a|4^60000*m.a.ratio|4^57*Yes|4^60001*10^1008*",
    "4^58*10|4^58*1009|4^26*day|4^33*Day|4^35*date|4^28*m.a|4^60000*m.a.day|4^57*Yes|4^60001*10^1009*",
    "4^58*10|4^58*1010|4^26*blob|4^33*Blob|4^35*binary|4^28*m.a|4^60000*m.a.blob|4^57*Yes|4^60001*10^1010*",
]


@pytest.fixture(scope="module")
def catalog(spark):
    df = spark.createDataFrame(list(enumerate(LINES, start=1)), "line_no long, value string")
    return parse_catalog(df).good


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "Acme|Corp", 450000.0, True, dt.datetime(2025, 1, 15, 14, 30), 201, [1, 2, 3], 0.125,
         dt.date(2025, 1, 15), "x"),
        (2, None, None, None, None, None, [], None, None, None),
        (3, "  padded  ", 1234.5, False, dt.datetime(2025, 1, 15, 14, 30, 0, 500000), None, None, 2.0, None, ""),
    ]
    schema = ("id long, name string, amount double, flag boolean, `when` timestamp_ntz, partner_id long, "
              "tag_ids array<long>, ratio double, day date, blob string")
    return spark.createDataFrame(rows, schema)


def _encoded(catalog, records):
    return {r["record_id"]: r["encoded_string"] for r in
            codec.encode_records(records, cat.encoding_map(catalog), "m.a").collect()}


def test_encode_value_branches(catalog, records):
    enc = _encoded(catalog, records)
    assert enc[1] == ("10^1001*1|10^1002*Acme\\|Corp|10^1003*450000|10^1004*TRUE|10^1005*2025-01-15 14:30:00|"
                      "20^2001*201|10^1007*[1,2,3]|10^1008*0.125|10^1009*2025-01-15|10^1010*[binary]")
    # NULL -> empty text except boolean (FALSE); empty array -> []
    assert enc[2] == ("10^1001*2|10^1002*|10^1003*|10^1004*FALSE|10^1005*|20^2001*|10^1007*[]|10^1008*|"
                      "10^1009*|10^1010*")
    assert "10^1005*2025-01-15 14:30:00.500000" in enc[3]
    assert "10^1008*2|" in enc[3] and "10^1003*1234.5|" in enc[3]
    assert "10^1010*|" not in enc[3] and enc[3].endswith("10^1010*")  # empty string binary -> empty


def test_field_count_counts_fields_not_pipes(catalog, records):
    rows = codec.encode_records(records, cat.encoding_map(catalog), "m.a").collect()
    assert {r["field_count"] for r in rows} == {10}  # Q6 fix: escaped pipes do not inflate


def test_restricted_markers(catalog, records):
    enc = codec.encode_records(records, cat.encoding_map(catalog), "m.a",
                               restrictions={"name": "compute_error", "amount": "odoo_error"})
    s = enc.filter("record_id = 1").first()["encoded_string"]
    assert "10^1002*Restricted_from_API" in s and "10^1003*Restricted_odoo_error" in s
    dec = codec.decode_records(enc, cat.coord_lookup(catalog)).filter("record_id = 1")
    shown = {r["field_name"]: r["display_value"] for r in dec.collect()}
    assert shown["name"] == "[API Restricted]" and shown["amount"] == "[Odoo Error]"


def test_display_branches(catalog, records):
    enc = codec.encode_records(records, cat.encoding_map(catalog), "m.a")
    dec = {(r["record_id"], r["field_name"]): r["display_value"]
           for r in codec.decode_records(enc, cat.coord_lookup(catalog)).collect()}
    assert dec[(1, "name")] == "Acme|Corp"          # unescaped
    assert dec[(1, "amount")] == "$450,000"
    assert dec[(3, "amount")] == "$1,235"           # half away from zero (Q25)
    assert dec[(1, "flag")] == "Yes" and dec[(2, "flag")] == "No"
    assert dec[(1, "when")] == "Jan 15, 2025, 02:30 PM"
    assert dec[(1, "day")] == "Jan 15, 2025"
    assert dec[(1, "partner_id")] == "#201 (m.p)"   # FK entry (no native row for 20^2001)
    assert dec[(1, "tag_ids")] == "[3 items]" and dec[(2, "tag_ids")] == "-"
    assert dec[(1, "ratio")] == "0.13" and dec[(3, "ratio")] == "2.00"
    assert dec[(1, "blob")] == "[binary data]"
    assert dec[(2, "name")] == "-"
    assert dec[(3, "name")] == "  padded"           # Q7: segment ends trimmed, value keeps its lead


def test_display_numeric_prefix_and_text_cut(spark):
    df = spark.createDataFrame([("12abc", "integer"), ("3.5kg", "float"), ("x" * 120, "text"),
                                ("abc", "monetary"), ("1234567", "integer")], "raw string, t string")
    out = [r[0] for r in df.select(display_value(F.col("raw"), F.col("t"), F.lit(None).cast("string"))).collect()]
    assert out[0] == "12" and out[1] == "3.50"      # Q27 prefix parse
    assert out[2] == "x" * 100 + "..."
    assert out[3] == "abc" and out[4] == "1,234,567"


def test_multiline_values_survive(spark, catalog):
    enc = spark.createDataFrame([(1, "m.a", "10^1002*line one\nline two|10^1003*5")],
                                "record_id long, model_name string, encoded_string string")
    dec = codec.decode_records(enc, cat.coord_lookup(catalog)).orderBy("pos").collect()
    assert dec[0]["raw_value"] == "line one\nline two"   # Q4 fix
    assert dec[1]["display_value"] == "$5"


def test_malformed_and_unknown_segments(spark, catalog):
    enc = spark.createDataFrame([(1, "m.a", "garbage|10^1002*ok|99^99*unknown| |10^1003*7")],
                                "record_id long, model_name string, encoded_string string")
    assert codec.malformed_segments(enc).count() == 1
    stats = codec.decode_stats(enc, cat.coord_lookup(catalog)).first()
    assert (stats["total_segments"], stats["decoded_fields"], stats["unknown_coordinates"]) == (3, 2, 1)
    assert stats["field_types"] == "char:1,monetary:1"
    txt = codec.decode_text(enc, cat.coord_lookup(catalog)).first()["decoded_text"]
    assert txt == "- **Name:** ok\n- **Amount:** $7"


def test_no_decodable_fallback(spark, catalog):
    enc = spark.createDataFrame([(1, "m.a", "99^1*x")], "record_id long, model_name string, encoded_string string")
    assert codec.decode_text(enc, cat.coord_lookup(catalog)).first()["decoded_text"] == "_No decodable fields found_"


def test_key_field_filter(spark, catalog, records):
    enc = codec.encode_records(records, cat.encoding_map(catalog), "m.a")
    txt = codec.decode_text(enc, cat.coord_lookup(catalog), {"m.a": ["name", "amount"]}).filter("record_id = 1")
    assert txt.first()["decoded_text"] == "- **Name:** Acme|Corp\n- **Amount:** $450,000"


def test_trailing_backslash_swallows_next_segment(spark, catalog):
    # Q5 kept: a value ending in a backslash escapes the separator
    recs = spark.createDataFrame([(1, "a\\", 3.0)], "id long, name string, amount double")
    enc = codec.encode_records(recs, cat.encoding_map(catalog), "m.a")
    dec = codec.decode_records(enc, cat.coord_lookup(catalog)).collect()
    assert "amount" not in {r["field_name"] for r in dec}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab|*^\n é 😀\t1")), min_size=0, max_size=30),
                min_size=1, max_size=5))
def test_roundtrip_property(spark, catalog, texts):
    """decode(encode(x)) == x without trailing white space (values without a final backslash)."""
    recs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, name string")
    enc = codec.encode_records(recs, cat.encoding_map(catalog), "m.a")
    got = {r["record_id"]: r["raw_value"] for r in codec.decode_records(enc, cat.coord_lookup(catalog))
           .filter("field_name = 'name'").collect()}
    want = {r["id"]: r["t"] for r in recs.select("id", js_rtrim(F.col("name")).alias("t")).collect()}
    assert got == want


def test_decode_in_the_row_equals_decode_by_segment(spark, catalog, records):
    """Records as encoded, shifted, foreign, malformed, empty and NULL: text and counts equal those
    built from the exploded segments."""
    emap, lookup = cat.encoding_map(catalog), cat.coord_lookup(catalog)
    enc = codec.encode_records(records, emap, "m.a").select("record_id", "model_name", "encoded_string")
    odd = ["", None, "10^1003*5|10^1002*swapped", "garbage|10^1002*x  |99^9*y", " 10^1001*7 |010^01002*zero",
           "10^1001*1|10^1002*a\\|b|10^1003*-|" * 2, "20^2001*7|10^1010*[binary]", "10^1002*" + "long " * 60]
    enc = enc.union(spark.createDataFrame([(100 + i, "m.a", e) for i, e in enumerate(odd)] + [(200, "unknown.model", "10^1002*q")],
                                          "record_id long, model_name string, encoded_string string"))
    rows = {}
    for r in codec.decode_records(enc, lookup).orderBy("record_id", "pos").collect():
        rows.setdefault(r["record_id"], []).append(r)
    want = {r["record_id"]: "\n".join(f"- **{x['field_label']}:** {x['display_value']}" for x in rows.get(r["record_id"], []))
            or "_No decodable fields found_" for r in enc.collect()}
    for kw in ({"emap": emap}, {"emap": emap, "model": "m.a"}, {}):
        got = {r["record_id"]: r["decoded_text"] for r in codec.decode_text(enc, lookup, **kw).collect()}
        assert got == want, kw
    valid = {r["record_id"]: r["n"] for r in codec.parse_encoded(enc).groupBy("record_id").agg(F.count("*").alias("n")).collect()}
    for kw in ({"emap": emap}, {}):
        stats = {r["record_id"]: (r["total_segments"], r["decoded_fields"]) for r in codec.decode_stats(enc, lookup, **kw).collect()}
        assert stats == {r: (valid.get(r, 0), len(rows.get(r, []))) for r in want}
    whole = codec.decode_text(enc, lookup, emap=emap, model="m.a", text_cut=None).filter("record_id = 107").first()["decoded_text"]
    assert whole == "- **Name:** " + ("long " * 60).strip()
