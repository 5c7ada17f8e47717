"""Catalog parsing, bad rows, encoding map and lookup priority (Q1, Q3, Q8, Q9)."""

from coordspark.operators import catalog as cat
from coordspark.plans import fixture as fx
from coordspark.sources.catalog_text import parse_catalog, read_catalog_text

GOOD = "4^58*292|4^58*28105|4^26*account_type|4^33*Type|4^35*selection|4^28*account.account|4^60000*account.account.account_type|4^57*Yes|4^60001*292^28105*"


def test_parse_example_line(spark):
    df = spark.createDataFrame([(1, GOOD)], "line_no long, value string")
    r = parse_catalog(df).good.first()
    assert (r.model_id, r.field_id, r.field_name, r.field_type, r.model_name) == \
        (292, 28105, "account_type", "selection", "account.account")
    assert r.stored is True and (r.primary_model_id, r.primary_field_id) == ("292", "28105")


def test_bad_rows_go_to_quarantine(spark):
    lines = [GOOD, "4^58*1|4^58*2|4^26*x", GOOD.replace("4^58*292", "4^58*abc"),
             GOOD.replace("4^57*Yes", "4^57*no"), GOOD.replace("292^28105*", "77*")]
    s = parse_catalog(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string"))
    assert s.bad.count() == 2
    good = {r.line_no: r for r in s.good.collect()}
    assert good[4].stored is False
    assert (good[5].primary_model_id, good[5].primary_field_id) == ("77", "")


def test_read_catalog_text_keeps_line_order(spark, tmp_path):
    p = tmp_path / "catalog.txt"
    rows = fx.catalog_rows()
    p.write_text("\n".join(fx.catalog_line(r) for r in rows[:5]) + "\n\n")
    df = read_catalog_text(spark, str(p))
    assert [r.line_no for r in df.collect()] == [1, 2, 3, 4, 5]


def _cat(spark, lines):
    return parse_catalog(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string")).good


def test_lookup_native_last_wins_and_fk_first(spark):
    base = "4^58*{m}|4^58*{f}|4^26*{n}|4^33*{n}|4^35*{t}|4^28*{mn}|4^60000*{loc}|4^57*Yes|4^60001*{ref}"
    lines = [
        base.format(m=5, f=51, n="a_id", t="many2one", mn="x", loc="t.id", ref="9^91*"),
        base.format(m=6, f=61, n="b_id", t="many2one", mn="y", loc="t.id", ref="9^91*"),
        base.format(m=7, f=71, n="first", t="char", mn="z", loc="z.first", ref="7^71*"),
        base.format(m=7, f=71, n="second", t="char", mn="z", loc="z.second", ref="7^71*"),
    ]
    lk = {r.coordinate: r for r in cat.coord_lookup(_cat(spark, lines)).collect()}
    assert lk["9^91"].field_name == "a_id" and lk["9^91"].target_model == "t"   # first FK
    assert lk["7^71"].field_name == "second"                                    # last native
    lines.append(base.format(m=9, f=91, n="id", t="integer", mn="t", loc="t.id", ref="9^91*"))
    lk = {r.coordinate: r for r in cat.coord_lookup(_cat(spark, lines)).collect()}
    assert lk["9^91"].field_name == "id"                                        # native beats FK (Q2)


def test_trailing_id_strip_only(spark):
    base = "4^58*1|4^58*11|4^26*f|4^33*F|4^35*many2one|4^28*m|4^60000*x.id_card.id|4^57*Yes|4^60001*2^21*"
    em = cat.encoding_map(_cat(spark, [base])).first()
    assert em.target_model == "x.id_card" and em.prefix == "2^21"   # Q3 fix


def test_duplicate_names_last_info_first_position(spark):
    base = "4^58*1|4^58*{f}|4^26*{n}|4^33*{n}|4^35*{t}|4^28*m|4^60000*m.{n}|4^57*Yes|4^60001*1^{f}*"
    lines = [base.format(f=11, n="a", t="char"), base.format(f=12, n="b", t="char"),
             base.format(f=13, n="a", t="integer")]
    em = {r.field_name: r for r in cat.encoding_map(_cat(spark, lines)).collect()}
    assert em["a"].line_no == 1 and em["a"].field_type == "integer" and em["a"].prefix == "1^13"  # Q9


def test_empty_primary_ids_give_bare_caret(spark):
    base = "4^58*1|4^58*11|4^26*f|4^33*F|4^35*many2one|4^28*m|4^60000*t.id|4^57*Yes|4^60001*"
    assert cat.encoding_map(_cat(spark, [base])).first().prefix == "^"          # Q8 kept


def test_model_config_and_suggestions(spark):
    c = fx.catalog(spark, "/root/testdata/sf0.001")
    conf = {r.model_name: r for r in cat.model_config(c).collect()}
    assert conf["customer"].id_field_id == 301 and conf["customer"].status == "ok"
    assert conf["lineitem"].status == "no id field"
    assert [r.model_name for r in cat.name_suggestions(c, "order.x").collect()] == ["orders"]
