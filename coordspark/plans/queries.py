"""Registered queries: each is a Spark callable ``(spark, sf_dir) -> DataFrame``
over the driver tables, plus (where SQL can say it) the DuckDB SQL that must
give the same rows. ``__spark_entry__`` exposes both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import js_rtrim, js_trim
from ..operators import catalog as cat
from ..operators import codec
from ..operators import points as pts
from ..operators import vector_index as vix
from ..operators import vectors as vec
from ..session import scratch_path, table_path
from ..sources.catalog_text import parse_catalog
from . import fixture as fx
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- shared builders -------------------------------------------------------------

def _catalog(spark, sf, exclude=()):
    return fx.catalog(spark, sf, exclude)


def _seen_catalog(spark, sf, exclude=()):
    """The catalog of the columns that hold a value in some row of the tables."""
    return fx.catalog(spark, sf, exclude, seen=True)


def _encode(spark, sf, model, catalog=None, plan=None):
    if plan is None:
        catalog = catalog if catalog is not None else _catalog(spark, sf)
        plan = codec.encoding_plan(cat.encoding_map(catalog))
    return codec.encode_records(fx.record_view(spark, sf, model), plan, model)


def _points(spark, sf, catalog=None):
    c = _catalog(spark, sf)
    plan = codec.encoding_plan(cat.encoding_map(c))
    encs = [_encode(spark, sf, m, plan=plan) for m in fx.models_with_id()]
    return pts.point_table(pts.schema_points(c if catalog is None else catalog), *[pts.data_points(e) for e in encs])


def doc_points(spark, sf) -> DataFrame:
    """Vector points: embeddings joined to documents (vec_id = doc_id); the
    label plays the model name and the language the field type."""
    e = fx.read_table(spark, sf, "embeddings")
    d = fx.read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    return (e.join(d, e["vec_id"] == d["doc_id"], "inner")
            .select(F.col("vec_id").alias("id"), F.lit("data").alias("point_type"),
                    F.col("embedding").alias("vector"),
                    F.concat(F.lit("label_"), F.col("label").cast("string")).alias("model_name"),
                    F.col("lang").alias("field_type"), F.col("source").alias("field_name")))


def _first_vector(points: DataFrame) -> list[float]:
    row = points.orderBy("id").select("vector").limit(1).collect()
    return [float(x) for x in row[0]["vector"]]


DOC_POINTS_SQL = """p AS (SELECT e.vec_id AS id, 'label_' || CAST(e.label AS VARCHAR) AS model_name,
  d.lang AS field_type, d.source AS field_name, CAST(e.embedding AS DOUBLE[]) AS v
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""


def _score_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


# --- codec ---------------------------------------------------------------------------

@register("encode_customer", o.with_ctes(o.catalog_cte()) + o.encode_select("customer"))
def q_encode_customer(spark, sf):
    return _encode(spark, sf, "customer")


@register("encode_orders", o.encode_select("orders"))
def q_encode_orders(spark, sf):
    return _encode(spark, sf, "orders")


_ENC_CUST = "enc AS (" + o.encode_select("customer") + ")"


@register("decode_customer_key_fields",
          o.with_ctes(o.catalog_cte(), o.LOOKUP_CTE, o.key_fields_cte(), _ENC_CUST, o.SEGMENTS_CTE)
          + o.decoded_select(True))
def q_decode_customer_key_fields(spark, sf):
    c = _catalog(spark, sf)
    return codec.decode_records(_encode(spark, sf, "customer", c), cat.coord_lookup(c), fx.key_fields(spark))


@register("decode_customer_fk_branch",
          o.with_ctes(o.catalog_cte(("nation",)), o.LOOKUP_CTE, _ENC_CUST, o.SEGMENTS_CTE)
          + o.decoded_select(False))
def q_decode_customer_fk_branch(spark, sf):
    """Decode against a catalog without the nation rows: ``c_nationkey`` resolves
    through the many2one entry (FK display) instead of nation's ``id``."""
    full = _catalog(spark, sf)
    c = _catalog(spark, sf, ("nation",))
    return codec.decode_records(_encode(spark, sf, "customer", full), cat.coord_lookup(c))


@register("decode_text_customer",
          o.with_ctes(o.catalog_cte(), o.LOOKUP_CTE, _ENC_CUST, o.SEGMENTS_CTE) + o.decoded_text_select(False))
def q_decode_text_customer(spark, sf):
    c = _catalog(spark, sf)
    plan = codec.encoding_plan(cat.encoding_map(c))
    return codec.decode_text(_encode(spark, sf, "customer", plan=plan), cat.coord_lookup(c), emap=plan, model="customer")


@register("decode_text_orders",
          o.with_ctes(o.catalog_cte(), o.LOOKUP_CTE, "enc AS (" + o.encode_select("orders") + ")", o.SEGMENTS_CTE)
          + o.decoded_text_select(False))
def q_decode_text_orders(spark, sf):
    c = _catalog(spark, sf)
    plan = codec.encoding_plan(cat.encoding_map(c))
    return codec.decode_text(_encode(spark, sf, "orders", plan=plan), cat.coord_lookup(c), emap=plan, model="orders")


_ALL_ENC = "enc AS (" + "\nUNION ALL\n".join(o.encode_select(m) for m in fx.models_with_id()) + ")"


def _decode_stats_sql() -> str:
    return o.with_ctes(o.catalog_cte(("region",)), o.LOOKUP_CTE, _ALL_ENC, o.SEGMENTS_CTE) + """
SELECT e.record_id, e.model_name,
  CAST(coalesce(t.total, 0) AS INTEGER) AS total_segments,
  CAST(coalesce(t.decoded, 0) AS INTEGER) AS decoded_fields,
  CAST(coalesce(t.total, 0) - coalesce(t.decoded, 0) AS INTEGER) AS unknown_coordinates,
  coalesce(ty.field_types, '') AS field_types
FROM enc e
LEFT JOIN (SELECT p.record_id, p.model_name, count(*) AS total, count(l.coordinate) AS decoded
           FROM parsed p LEFT JOIN lookup l ON p.coordinate = l.coordinate GROUP BY 1, 2) t
  ON e.record_id = t.record_id AND e.model_name = t.model_name
LEFT JOIN (SELECT record_id, model_name, string_agg(field_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY field_type) AS field_types
           FROM (SELECT p.record_id, p.model_name, l.field_type, count(*) AS n
                 FROM parsed p JOIN lookup l ON p.coordinate = l.coordinate GROUP BY 1, 2, 3) x
           GROUP BY 1, 2) ty
  ON e.record_id = ty.record_id AND e.model_name = ty.model_name"""


@register("decode_stats", _decode_stats_sql())
def q_decode_stats(spark, sf):
    """A13 over the records of every model with an id, decoded against a catalog
    without the region model (region's own fields become unknown)."""
    plan = codec.encoding_plan(cat.encoding_map(_catalog(spark, sf)))
    encs = [_encode(spark, sf, m, plan=plan) for m in fx.models_with_id()]
    enc = encs[0]
    for e in encs[1:]:
        enc = enc.unionByName(e)
    return codec.decode_stats(enc, cat.coord_lookup(_catalog(spark, sf, ("region",))), plan)


@register("roundtrip_documents",
          o.with_ctes(o.catalog_cte(), o.LOOKUP_CTE, "enc AS (" + o.encode_select("documents") + ")", o.SEGMENTS_CTE)
          + f"""SELECT p.record_id, p.raw_value AS decoded_text,
  p.raw_value = {o.js_rtrim('d.text')} AS roundtrip_ok
FROM parsed p JOIN lookup l ON p.coordinate = l.coordinate JOIN documents d ON d.doc_id = p.record_id
WHERE l.field_name = 'text' AND l.model_name = 'documents'""")
def q_roundtrip_documents(spark, sf):
    """Encode every document and decode its text field back; compare with the
    original without trailing white space (Q7)."""
    c = _catalog(spark, sf)
    docs = fx.record_view(spark, sf, "documents")
    enc = codec.encode_records(docs.withColumn("orig", F.col("text")), cat.encoding_map(c), "documents",
                               keep=("orig",))
    dec = codec.decode_records(enc, cat.coord_lookup(c), carry=("orig",))
    text = dec.filter((F.col("field_name") == "text") & (F.col("field_model") == "documents"))
    return text.select("record_id", F.col("raw_value").alias("decoded_text"),
                       (F.col("raw_value") == js_rtrim(F.col("orig"))).alias("roundtrip_ok"))


# --- catalog -------------------------------------------------------------------------------

_PARSE_SQL = o.with_ctes(o.seen_line_cte()) + f"""
, cols AS (SELECT line_no, {o.js_trim('value')} AS line, string_split({o.js_trim('value')}, '|') AS c FROM catalog_text),
vals AS (SELECT line_no, line, len(c) AS n_cols, {", ".join(
    f"CASE WHEN strpos(c[{i + 1}], '*') > 0 THEN regexp_extract(c[{i + 1}], '(?s)^[^*]*\\*(.*?)\\*?$', 1) ELSE c[{i + 1}] END AS v{i}"
    for i in range(9))} FROM cols)
SELECT line_no,
  CAST(TRY_CAST(regexp_extract(v0, '{o.INT_PREFIX}', 1) AS BIGINT) AS INTEGER) AS model_id,
  CAST(TRY_CAST(regexp_extract(v1, '{o.INT_PREFIX}', 1) AS BIGINT) AS INTEGER) AS field_id,
  v2 AS field_name, v3 AS field_label, v4 AS field_type, v5 AS model_name, v6 AS primary_data_location,
  lower(v7) = 'yes' AS stored,
  CASE WHEN strpos(v8, '^') > 0 THEN coalesce(string_split(v8, '^')[1], '') ELSE coalesce(v8, '') END AS primary_model_id,
  CASE WHEN strpos(v8, '^') > 0 THEN coalesce(string_split(v8, '^')[2], '') ELSE '' END AS primary_field_id,
  line AS raw_encoded
FROM vals
WHERE n_cols >= 9 AND TRY_CAST(regexp_extract(v0, '{o.INT_PREFIX}', 1) AS BIGINT) IS NOT NULL
  AND TRY_CAST(regexp_extract(v1, '{o.INT_PREFIX}', 1) AS BIGINT) IS NOT NULL"""


@register("catalog_parse", _PARSE_SQL)
def q_catalog_parse(spark, sf):
    return parse_catalog(fx.catalog_text_df(spark, sf, seen=True)).good


@register("encoding_map", o.with_ctes(o.seen_catalog_cte(), o.EMAP_CTE) + "SELECT * FROM emap")
def q_encoding_map(spark, sf):
    return cat.encoding_map(_seen_catalog(spark, sf))


@register("coord_lookup", o.with_ctes(o.seen_catalog_cte(), o.LOOKUP_CTE) + "SELECT * FROM lookup")
def q_coord_lookup(spark, sf):
    return cat.coord_lookup(_seen_catalog(spark, sf))


@register("encoding_preview", o.with_ctes(o.seen_catalog_cte(), o.EMAP_CTE) + """
SELECT model_name, CAST(row_number() OVER (ORDER BY line_no) AS INTEGER) AS position, field_name, prefix,
  field_type AS type, (SELECT count(*) FROM catalog WHERE model_name = 'lineitem') AS field_count
FROM emap WHERE model_name = 'lineitem' ORDER BY line_no LIMIT 20""")
def q_encoding_preview(spark, sf):
    return cat.encoding_preview(_seen_catalog(spark, sf), "lineitem")


_POINT_COLS_SQL = ("CAST(field_id AS BIGINT) AS id, model_name, field_name, field_label, field_type, stored, "
                   "primary_data_location, 1.0 AS score")


def _point_view(df: DataFrame) -> DataFrame:
    return df.select("id", "model_name", "field_name", "field_label", "field_type", "stored",
                     "primary_data_location", "score")


@register("list_fields", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT {_POINT_COLS_SQL} FROM catalog WHERE model_name = 'lineitem'")
def q_list_fields(spark, sf):
    return _point_view(pts.list_fields(_points(spark, sf, _seen_catalog(spark, sf)), "lineitem"))


@register("list_fields_stored", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT {_POINT_COLS_SQL} FROM catalog WHERE model_name = 'orders' AND stored "
          "AND field_type IN ('integer', 'monetary')")
def q_list_fields_stored(spark, sf):
    return _point_view(pts.list_fields(_points(spark, sf, _seen_catalog(spark, sf)), "orders", ["integer", "monetary"], stored_only=True))


@register("references_out", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT {_POINT_COLS_SQL} FROM catalog WHERE model_name = 'lineitem' "
          "AND field_type IN ('many2one', 'one2many', 'many2many')")
def q_references_out(spark, sf):
    return _point_view(pts.references_out(_points(spark, sf, _seen_catalog(spark, sf)), "lineitem"))


@register("references_in", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT {_POINT_COLS_SQL} FROM catalog WHERE field_type = 'many2one' "
          "AND primary_data_location = 'nation.id'")
def q_references_in(spark, sf):
    return _point_view(pts.references_in(_points(spark, sf, _seen_catalog(spark, sf)), "nation"))


@register("references_in_by_model", o.with_ctes(o.seen_catalog_cte()) + """
SELECT model_name, count(*) AS n, string_agg(field_name, ',' ORDER BY field_name) AS fields
FROM catalog WHERE field_type = 'many2one' AND primary_data_location = 'nation.id' GROUP BY model_name""")
def q_references_in_by_model(spark, sf):
    return pts.counts_by(pts.references_in(_points(spark, sf, _seen_catalog(spark, sf)), "nation"), "model_name")


@register("fk_edges", o.with_ctes(o.seen_catalog_cte()) + """
SELECT model_name, regexp_replace(primary_data_location, '\\.id$', '') AS target_model, count(*) AS n_fields,
  string_agg(field_name, ',' ORDER BY field_name) AS fields
FROM catalog WHERE field_type = 'many2one' GROUP BY 1, 2""")
def q_fk_edges(spark, sf):
    return cat.fk_edges(_seen_catalog(spark, sf))


@register("catalog_stats", o.with_ctes(o.seen_catalog_cte()) + """
SELECT count(*) AS total_fields, count(DISTINCT model_name) AS models,
  count(*) FILTER (WHERE stored) AS stored_count, count(*) FILTER (WHERE NOT stored) AS computed_count
FROM catalog""")
def q_catalog_stats(spark, sf):
    return cat.catalog_stats(_seen_catalog(spark, sf))


@register("type_counts", o.with_ctes(o.seen_catalog_cte()) +
          "SELECT field_type, count(*) AS n FROM catalog GROUP BY 1 ORDER BY n DESC, field_type LIMIT 10")
def q_type_counts(spark, sf):
    return cat.type_counts(_seen_catalog(spark, sf))


@register("model_names", o.with_ctes(o.seen_catalog_cte()) + "SELECT DISTINCT model_name FROM catalog")
def q_model_names(spark, sf):
    return cat.model_names(_seen_catalog(spark, sf))


@register("model_config", o.with_ctes(o.seen_catalog_cte()) + """
SELECT model_name, arg_min(model_id, line_no) AS model_id,
  arg_min(field_id, line_no) FILTER (WHERE field_name = 'id') AS id_field_id, count(*) AS field_count,
  CASE WHEN count(*) FILTER (WHERE field_name = 'id') = 0 THEN 'no id field' ELSE 'ok' END AS status
FROM catalog GROUP BY model_name""")
def q_model_config(spark, sf):
    return cat.model_config(_seen_catalog(spark, sf))


@register("name_suggestions", o.with_ctes(o.seen_catalog_cte()) + """
SELECT DISTINCT model_name FROM catalog
WHERE lower(model_name) LIKE '%order%' OR lower(model_name) LIKE '%items%'
ORDER BY model_name LIMIT 5""")
def q_name_suggestions(spark, sf):
    return cat.name_suggestions(_seen_catalog(spark, sf), "order.items")


def _alignment_columns(spark, sf) -> DataFrame:
    """(model_name, field_name) of the columns each record view really has."""
    rows = []
    for m in fx.TABLE_COLUMNS:
        for f in fx.record_view(spark, sf, m).columns:
            rows.append((m, f))
    return spark.createDataFrame(rows, "model_name string, field_name string")


def _alignment_sql() -> str:
    vals = []
    for m in fx.TABLE_COLUMNS:
        key = fx.KEY_COLUMNS.get(m)
        names = ["id" if n == key else n for n, _ in fx.TABLE_COLUMNS[m]]
        if m == "orders":
            names.append("line_count")
        vals += [f"({o.lit(m)}, {o.lit(n)})" for n in names]
    return o.with_ctes(o.seen_catalog_cte(), f"cols AS (SELECT * FROM (VALUES {', '.join(vals)}) AS t(model_name, field_name))") + """
SELECT c.model_name, c.field_name, 'matched' AS status FROM cols c
  WHERE EXISTS (SELECT 1 FROM catalog k WHERE k.model_name = c.model_name AND k.field_name = c.field_name)
UNION ALL
SELECT c.model_name, c.field_name, 'missing_in_schema' FROM cols c
  WHERE NOT EXISTS (SELECT 1 FROM catalog k WHERE k.model_name = c.model_name AND k.field_name = c.field_name)
UNION ALL
SELECT DISTINCT k.model_name, k.field_name, 'missing_in_source' FROM catalog k
  WHERE k.model_name IN (SELECT model_name FROM cols)
    AND NOT EXISTS (SELECT 1 FROM cols c WHERE k.model_name = c.model_name AND k.field_name = c.field_name)"""


@register("catalog_alignment", _alignment_sql())
def q_catalog_alignment(spark, sf):
    return cat.column_alignment(_alignment_columns(spark, sf), _seen_catalog(spark, sf))


# --- points ----------------------------------------------------------------------------------

def _all_ids_sql() -> str:
    parts = [f"SELECT {fx.MODEL_IDS[m]} AS model_id, CAST({fx.KEY_COLUMNS[m]} AS BIGINT) AS record_id FROM {m}"
             for m in fx.models_with_id()]
    return "\nUNION ALL\n".join(parts)


@register("point_counts", o.with_ctes(o.catalog_cte()) + f"""
SELECT (SELECT count(*) FROM catalog) + (SELECT count(*) FROM ({_all_ids_sql()}) a) AS total_points,
  (SELECT count(*) FROM ({_all_ids_sql()}) a) AS data_points,
  (SELECT count(*) FROM catalog) AS schema_points""")
def q_point_counts(spark, sf):
    return pts.point_counts(_points(spark, sf))


@register("data_point_ids", f"""
SELECT CAST(model_id AS BIGINT) * 10000000 + record_id AS id, model_id, record_id FROM ({_all_ids_sql()}) a""")
def q_data_point_ids(spark, sf):
    p = _points(spark, sf).filter(F.col("point_type") == "data")
    return p.select("id", "model_id", "record_id")


# --- vectors ---------------------------------------------------------------------------------

@register("knn_top10", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
SELECT id, model_name, score FROM (
  SELECT id, model_name, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s
  FROM p, q ORDER BY s DESC, id LIMIT 10) t WHERE s >= 0.35""")
def q_knn_top10(spark, sf):
    p = doc_points(spark, sf)
    hits = vec.knn_search(p, _first_vector(p), k=10, min_score=0.35)
    return hits.select("id", "model_name", F.round("score", 6).alias("score"))


@register("knn_filtered", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
SELECT id, model_name, field_type, score FROM (
  SELECT id, model_name, field_type, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s
  FROM p, q WHERE model_name = 'label_3' AND field_type IN ('en', 'fr') ORDER BY s DESC, id LIMIT 10) t
WHERE s >= 0.1""")
def q_knn_filtered(spark, sf):
    p = doc_points(spark, sf)
    pred = pts.payload_filter("label_3", ["en", "fr"], point_type="data")
    hits = vec.knn_search(p, _first_vector(p), k=10, min_score=0.1, pred=pred)
    return hits.select("id", "model_name", "field_type", F.round("score", 6).alias("score"))


@register("knn_min_score", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
SELECT id, score FROM (
  SELECT id, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s
  FROM p, q ORDER BY s DESC, id LIMIT 200) t WHERE s >= 0.5""")
def q_knn_min_score(spark, sf):
    p = doc_points(spark, sf)
    hits = vec.knn_search(p, _first_vector(p), k=200, min_score=0.5)
    return hits.select("id", F.round("score", 6).alias("score"))


@register("knn_batch", o.with_ctes(DOC_POINTS_SQL) + f"""
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT q.id AS query_id, p.id, round({_score_sql('p.v', 'q.v')}, 6) AS score, {_score_sql('p.v', 'q.v')} AS s,
    row_number() OVER (PARTITION BY q.id ORDER BY {_score_sql('p.v', 'q.v')} DESC, p.id) AS rank
  FROM p q, p) t WHERE rank <= 10 AND s >= 0.35""")
def q_knn_batch(spark, sf):
    """Every document vector is a query against all of them (top 10, min 0.35)."""
    p = doc_points(spark, sf)
    queries = p.select(F.col("id").alias("query_id"), "vector")
    hits = vec.knn_batch(p, queries, k=10, min_score=0.35)
    return hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register("search_quality", o.with_ctes(DOC_POINTS_SQL) + f"""
, hits AS (SELECT query_id, id, model_name, qlabel FROM (
    SELECT q.id AS query_id, p.id, p.model_name, q.model_name AS qlabel, {_score_sql('p.v', 'q.v')} AS s,
      row_number() OVER (PARTITION BY q.id ORDER BY {_score_sql('p.v', 'q.v')} DESC, p.id) AS rank
    FROM p q, p WHERE q.id <> p.id) t WHERE rank <= 5 AND s >= 0.3),
per_q AS (SELECT p.id AS query_id, p.model_name AS label,
    coalesce(max(CASE WHEN h.model_name = h.qlabel THEN 1 ELSE 0 END), 0) AS hit
  FROM p LEFT JOIN hits h ON h.query_id = p.id GROUP BY 1, 2)
SELECT label, count(*) AS n_queries, sum(hit) AS n_hits, round(sum(hit) / count(*), 6) AS pass_rate
FROM per_q GROUP BY label""")
def q_search_quality(spark, sf):
    return vec.search_quality(doc_points(spark, sf))


_BOUND, _LISTS, _PROBES = 0.25, 16, 12


def _code_sql(v: str) -> str:
    return (f"list_transform({v}, lambda x: CAST(round(greatest(-{_BOUND}, least({_BOUND}, x)) / {_BOUND} * 127) AS INTEGER))")


@register("knn_int8", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
, c AS (SELECT id, model_name, v, qv, list_sum(list_transform(list_zip({_code_sql('v')}, {_code_sql('qv')}), lambda z: z[1] * z[2])) AS approx
  FROM p, q ORDER BY approx DESC, id LIMIT 20)
SELECT id, model_name, score FROM (
  SELECT id, model_name, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s FROM c ORDER BY s DESC, id LIMIT 10) t
WHERE s >= 0.0""")
def q_knn_int8(spark, sf):
    """V6 over stored codes with a given clip bound: integer products choose 20 rows, an exact rescore 10."""
    p = doc_points(spark, sf)
    path = vix.write_codes(p, scratch_path(spark, "int8"), bound=_BOUND)
    hits = vix.knn_codes(spark, path, _first_vector(p), k=10, min_score=0.0)
    return hits.select("id", "model_name", F.round("score", 6).alias("score"))


@register("knn_inverted_file", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
, lead AS (SELECT id AS lid, v AS lv FROM p ORDER BY md5(CAST(id AS VARCHAR)) LIMIT {_LISTS}),
placed AS (SELECT id, arg_max(lid, {_score_sql('v', 'lv')}) AS lid FROM p, lead GROUP BY id),
probed AS (SELECT lid FROM lead, q ORDER BY {_score_sql('lv', 'qv')} DESC LIMIT {_PROBES})
SELECT id, model_name, score FROM (
  SELECT p.id, model_name, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s
  FROM p JOIN placed USING (id) JOIN probed USING (lid), q ORDER BY s DESC, p.id LIMIT 10) t WHERE s >= 0.0""")
def q_knn_inverted_file(spark, sf):
    """V5 over a stored inverted file: 16 lists, the 12 nearest are read."""
    p = doc_points(spark, sf)
    path = vix.write_inverted_file(p, scratch_path(spark, "inverted-file"), lists=_LISTS)
    hits = vix.knn_inverted_file(spark, path, _first_vector(p), k=10, probes=_PROBES, min_score=0.0)
    return hits.select("id", "model_name", F.round("score", 6).alias("score"))


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    """V5 (approximate: rows-only check): random-projection LSH candidates, exact rescore."""
    p = doc_points(spark, sf)
    hits = vec.knn_lsh(p, _first_vector(p), k=10, min_score=0.0)
    return hits.select("id", "model_name", F.round("score", 6).alias("score"))


# --- change handling ---------------------------------------------------------------------------

from ..operators import changes as chg  # noqa: E402
from ..operators import ops  # noqa: E402
from . import derived as dv  # noqa: E402

_CHANGES_SQL = """changes AS (
  SELECT coalesce(c.id, p.id) AS id,
    CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'deleted'
         WHEN c.checksum IS DISTINCT FROM p.checksum THEN 'modified' ELSE 'unchanged' END AS change
  FROM cur c FULL OUTER JOIN prev p ON c.id = p.id)"""


def _changes(spark, sf):
    return chg.detect_changes(dv.previous_snapshot(spark, sf), dv.current_snapshot(spark, sf))


@register("change_detection", o.with_ctes(dv.CURRENT_SNAPSHOT_SQL, dv.PREVIOUS_SNAPSHOT_SQL, _CHANGES_SQL)
          + "SELECT id, change FROM changes")
def q_change_detection(spark, sf):
    return _changes(spark, sf)


@register("change_summary", o.with_ctes(dv.CURRENT_SNAPSHOT_SQL, dv.PREVIOUS_SNAPSHOT_SQL, _CHANGES_SQL) + """
SELECT added, modified, deleted, unchanged,
  CASE WHEN added + modified + deleted = 0 THEN 'No changes detected'
       ELSE concat_ws(', ', CASE WHEN added > 0 THEN CAST(added AS VARCHAR) || ' added' END,
                      CASE WHEN modified > 0 THEN CAST(modified AS VARCHAR) || ' modified' END,
                      CASE WHEN deleted > 0 THEN CAST(deleted AS VARCHAR) || ' deleted' END) END AS summary
FROM (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified,
             count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) FILTER (WHERE change = 'unchanged') AS unchanged
      FROM changes) t""")
def q_change_summary(spark, sf):
    return chg.change_summary(_changes(spark, sf))


@register("changed_rows", o.with_ctes(dv.CURRENT_SNAPSHOT_SQL, dv.PREVIOUS_SNAPSHOT_SQL, _CHANGES_SQL)
          + "SELECT id, checksum FROM cur WHERE id IN (SELECT id FROM changes WHERE change IN ('added', 'modified'))")
def q_changed_rows(spark, sf):
    return chg.changed_rows(dv.current_snapshot(spark, sf), _changes(spark, sf))


@register("upsert_points", o.with_ctes(dv.CURRENT_SNAPSHOT_SQL) + "SELECT id, checksum FROM cur")
def q_upsert_points(spark, sf):
    """Incremental = full: previous snapshot + upsert(added, modified) - deleted == current, in one full outer join."""
    return chg.merge_snapshots(dv.previous_snapshot(spark, sf), dv.current_snapshot(spark, sf)).drop("change")


def _h60_sql(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"


@register("snapshot_header", o.with_ctes(dv.CURRENT_SNAPSHOT_SQL) + f"""
SELECT count(*) AS total_rows,
  CAST(coalesce(sum(CAST({_h60_sql("CAST(id AS VARCHAR) || ':' || checksum")} AS HUGEINT)) % 2305843009213693951, 0) AS BIGINT) AS digest_sum,
  CAST(coalesce(bit_xor({_h60_sql("CAST(id AS VARCHAR) || ':' || checksum")}), 0) AS BIGINT) AS digest_xor
FROM cur""")
def q_snapshot_header(spark, sf):
    return chg.snapshot_header(dv.current_snapshot(spark, sf))


def _semantic_sql() -> str:
    rel = "regexp_replace(primary_data_location, '\\.id$', '')"
    return f"""concat_ws(' ',
  'FIELD IN ' || model_name || ' (model_id ' || CAST(model_id AS VARCHAR) || '):',
  field_name || ' (field_id ' || CAST(field_id AS VARCHAR) || ')',
  '- model coordinate 4^58*' || CAST(model_id AS VARCHAR),
  '- field coordinate 4^58*' || CAST(field_id AS VARCHAR),
  'column attribute property of ' || model_name,
  CASE WHEN coalesce(field_label, '') <> '' AND field_label <> field_name THEN 'labeled "' || field_label || '"' END,
  '- ' || field_type || ' type',
  CASE WHEN field_type = 'many2one' THEN '- REFERENCES ' || {rel}
       WHEN field_type = 'one2many' THEN '- one2many related records in other model'
       WHEN field_type = 'many2many' THEN '- many2many related records' END,
  CASE WHEN field_type = 'many2one' THEN '- foreign key linking to ' || {rel} END,
  CASE WHEN stored THEN '- stored in database' ELSE '- computed field not stored' END,
  CASE WHEN coalesce(primary_data_location, '') <> '' AND primary_data_location <> 'Computed'
       THEN '- data at ' || primary_data_location END,
  CASE WHEN coalesce(primary_model_id, '') <> '' AND coalesce(primary_field_id, '') <> ''
       THEN '- primary ref ' || primary_model_id || '^' || primary_field_id END)"""


@register("semantic_text", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT CAST(field_id AS BIGINT) AS id, {_semantic_sql()} AS semantic_text FROM catalog")
def q_semantic_text(spark, sf):
    return pts.schema_points(_seen_catalog(spark, sf)).select("id", "semantic_text")


@register("field_checksums", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT CAST(field_id AS BIGINT) AS id, md5({_semantic_sql()}) AS checksum FROM catalog")
def q_field_checksums(spark, sf):
    return chg.snapshot(pts.schema_points(_seen_catalog(spark, sf)), "id", F.col("semantic_text"))


@register("catalog_changes", o.with_ctes(o.seen_catalog_cte(), "cur AS (SELECT CAST(field_id AS BIGINT) AS id, md5("
          + _semantic_sql() + ") AS checksum FROM catalog)", "prev AS (SELECT CAST(field_id AS BIGINT) AS id, md5("
          + _semantic_sql().replace("field_label", "CASE WHEN model_name = 'part' THEN upper(field_label) ELSE field_label END")
          + ") AS checksum FROM catalog WHERE model_name <> 'benchmark' UNION ALL SELECT 9999, 'gone')", _CHANGES_SQL)
          + "SELECT id, change FROM changes WHERE change <> 'unchanged'")
def q_catalog_changes(spark, sf):
    """I4 on the catalog: previous = catalog without benchmark, part labels upper-cased,
    plus one field that no longer exists."""
    c = _seen_catalog(spark, sf)
    cur = chg.snapshot(pts.schema_points(c), "id", F.col("semantic_text"))
    old_cat = c.filter(F.col("model_name") != "benchmark").withColumn(
        "field_label", F.when(F.col("model_name") == "part", F.upper("field_label")).otherwise(F.col("field_label")))
    prev = chg.snapshot(pts.schema_points(old_cat), "id", F.col("semantic_text")).unionByName(
        spark.range(1).select(F.lit(9999).cast("long").alias("id"), F.lit("gone").alias("checksum")))
    return chg.detect_changes(prev, cur).filter(F.col("change") != "unchanged")


# --- points: stale rows and keyed deletes ---------------------------------------------------

def _customer_points(spark, sf):
    return pts.data_points(_encode(spark, sf, "customer"))


def _source_customers(spark, sf):
    return fx.record_view(spark, sf, "customer").filter(F.col("id") % dv.STALE_EVERY != 0)


@register("stale_points", """
SELECT 3 * 10000000 + c_custkey AS id, c_custkey AS record_id, 'customer' AS model_name
FROM customer WHERE c_custkey % 20 = 0""")
def q_stale_points(spark, sf):
    return pts.stale_points(_customer_points(spark, sf), "customer", _source_customers(spark, sf))


@register("delete_points", "SELECT 3 * 10000000 + c_custkey AS id, c_custkey AS record_id FROM customer "
          "WHERE c_custkey % 20 <> 0")
def q_delete_points(spark, sf):
    p = _customer_points(spark, sf)
    stale = pts.stale_points(p, "customer", _source_customers(spark, sf))
    return pts.delete_ids(p, stale).select("id", "record_id")


@register("page_records", "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def q_page_records(spark, sf):
    """Stable page 3 of 500 orders in id order (a page is the feature)."""
    return pts.page(fx.record_view(spark, sf, "orders").select("id", "o_totalprice"), 1000, 500)


# --- high-water mark ---------------------------------------------------------------------------

_MARK_SQL = f"ts > TIMESTAMP '{dv.HIGH_WATER_MARK}'"


@register("highwater_increment", o.encode_select("events", where=_MARK_SQL))
def q_highwater_increment(spark, sf):
    """Events changed after the mark, encoded (the predicate reaches the scan)."""
    ev = chg.incremental_rows(fx.record_view(spark, sf, "events"), _mark(), "ts")
    return codec.encode_records(ev, cat.encoding_map(_catalog(spark, sf)), "events")


def _mark():
    import datetime as _dt
    return _dt.datetime.fromisoformat(dv.HIGH_WATER_MARK)


@register("max_change_time", f"SELECT count(*) AS records_loaded, max(ts) AS max_change_time FROM events WHERE {_MARK_SQL}")
def q_max_change_time(spark, sf):
    ev = chg.incremental_rows(fx.read_table(spark, sf, "events"), _mark(), "ts")
    return chg.max_change_time(ev, "ts")


@register("sync_state", f"""
SELECT 'events' AS model_name, max(ts) AS last_max_write_date, count(*) AS records_synced
FROM events WHERE {_MARK_SQL}""")
def q_sync_state(spark, sf):
    """K4: the state row after an incremental run from the mark."""
    ev = chg.incremental_rows(fx.read_table(spark, sf, "events"), _mark(), "ts")
    prev = spark.createDataFrame([("events", _mark(), 0)],
                                 "model_name string, last_max_write_date timestamp_ntz, records_synced long")
    return chg.next_state(prev, "events", ev, "ts")


# --- failed rows -------------------------------------------------------------------------------

_DLQ_SQL = """dlq AS (
  SELECT model_name, record_id, arg_max(model_id, seq) AS model_id, arg_max(failure_stage, seq) AS failure_stage,
    arg_max(error_message, seq) AS error_message, arg_max(batch_number, seq) AS batch_number,
    arg_max(encoded_string, seq) AS encoded_string, arg_max(failed_at, seq) AS failed_at,
    count(*) - 1 AS retry_count, min(seq) AS first_seq
  FROM flog GROUP BY model_name, record_id)"""


@register("dlq_upsert", o.with_ctes(dv.FAILURE_LOG_SQL, _DLQ_SQL) + "SELECT * FROM dlq")
def q_dlq_upsert(spark, sf):
    return ops.merge_failures(dv.failure_log(spark, sf))


@register("dlq_stats", o.with_ctes(dv.FAILURE_LOG_SQL, _DLQ_SQL) + """
SELECT CASE WHEN GROUPING(model_name) = 1 AND GROUPING(failure_stage) = 1 THEN 'total'
            WHEN GROUPING(failure_stage) = 1 THEN 'model' ELSE 'stage' END AS level,
  CASE WHEN GROUPING(failure_stage) = 1 AND GROUPING(model_name) = 0 THEN model_name
       WHEN GROUPING(model_name) = 1 AND GROUPING(failure_stage) = 0 THEN failure_stage END AS key,
  count(*) AS n
FROM dlq GROUP BY GROUPING SETS ((), (model_name), (failure_stage))""")
def q_dlq_stats(spark, sf):
    return ops.failure_stats(ops.merge_failures(dv.failure_log(spark, sf)))


@register("dlq_clear", o.with_ctes(dv.FAILURE_LOG_SQL, _DLQ_SQL) +
          "SELECT count(*) FILTER (WHERE model_name = 'orders') AS cleared, "
          "count(*) FILTER (WHERE model_name <> 'orders') AS remaining FROM dlq")
def q_dlq_clear(spark, sf):
    dlq = ops.merge_failures(dv.failure_log(spark, sf))
    remaining, cleared = ops.clear_failures(dlq, "orders")
    return cleared.withColumn("remaining", remaining.agg(F.count(F.lit(1))).scalar())


# --- usage and importance -------------------------------------------------------------------------

_USAGE_SQL = """usage AS (
  SELECT model_name, field_name, count(*) FILTER (WHERE context = 'decode') AS decode_count,
    count(*) FILTER (WHERE context = 'search') AS search_count, max(ts) AS last_used, min(seq) AS first_seq
  FROM ulog GROUP BY model_name, field_name)"""
_IMPORTANCE_SQL = """imp AS (
  SELECT u.model_name, u.field_name,
    floor((least(50, log10(decode_count + 1) * 20) + least(50, log10(search_count + 1) * 20)) * 10 + 0.5) / 10 AS total_score,
    decode_count AS decode_frequency, search_count AS search_frequency,
    k.field_name IS NULL AND least(50, log10(decode_count + 1) * 20) + least(50, log10(search_count + 1) * 20) >= 50 AS is_promoted,
    first_seq
  FROM usage u LEFT JOIN key_fields k ON k.model_name = u.model_name AND k.field_name = u.field_name)"""


@register("usage_counts", o.with_ctes(dv.USAGE_LOG_SQL, _USAGE_SQL) + "SELECT * FROM usage")
def q_usage_counts(spark, sf):
    return ops.usage_counts(dv.usage_log(spark, sf))


@register("field_importance", o.with_ctes(dv.USAGE_LOG_SQL, _USAGE_SQL, o.key_fields_cte(), _IMPORTANCE_SQL)
          + "SELECT * FROM imp")
def q_field_importance(spark, sf):
    return ops.field_importance(ops.usage_counts(dv.usage_log(spark, sf)), fx.key_fields(spark))


def _kf_rank_cte() -> str:
    rows = [(m, f, i) for m, fs in fx.KEY_FIELDS.items() for i, f in enumerate(fs)]
    vals = ", ".join(f"({o.lit(m)}, {o.lit(f)}, {i})" for m, f, i in rows)
    return f"kfr AS (SELECT * FROM (VALUES {vals}) AS t(model_name, field_name, key_rank))"


@register("adaptive_key_fields", o.with_ctes(dv.USAGE_LOG_SQL, _USAGE_SQL, o.key_fields_cte(), _IMPORTANCE_SQL,
                                             _kf_rank_cte()) + """
, models AS (SELECT 'events' AS model_name UNION SELECT 'customer'),
both_ AS (
  SELECT model_name, field_name, 0 AS grp, CAST(key_rank AS DOUBLE) AS o1, CAST(0 AS BIGINT) AS o2 FROM kfr
  UNION ALL
  SELECT model_name, field_name, 1, -total_score, first_seq FROM imp WHERE is_promoted)
SELECT model_name, CAST(rank AS INTEGER) AS rank, field_name FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY grp, o1, o2, field_name) AS rank
  FROM both_ WHERE model_name IN (SELECT model_name FROM models)) t WHERE rank <= 12""")
def q_adaptive_key_fields(spark, sf):
    imp = ops.field_importance(ops.usage_counts(dv.usage_log(spark, sf)), fx.key_fields(spark))
    return ops.adaptive_key_fields(imp, fx.key_fields(spark), ["events", "customer"])


@register("usage_summary", o.with_ctes(dv.USAGE_LOG_SQL, _USAGE_SQL, o.key_fields_cte(), _IMPORTANCE_SQL) + """
SELECT 'total_decodes' AS kind, 0 AS rank, CAST(NULL AS VARCHAR) AS item, CAST(sum(decode_count) AS DOUBLE) AS value FROM usage
UNION ALL
SELECT 'total_searches', 0, NULL, CAST(sum(search_count) AS DOUBLE) FROM usage
UNION ALL
SELECT 'top_field', CAST(row_number() OVER (ORDER BY decode_count + search_count DESC, first_seq) AS INTEGER),
  model_name || '.' || field_name, CAST(decode_count + search_count AS DOUBLE)
FROM usage QUALIFY row_number() OVER (ORDER BY decode_count + search_count DESC, first_seq) <= 10
UNION ALL
SELECT 'promotion', CAST(row_number() OVER (ORDER BY m.model_seq, total_score DESC, i.first_seq) AS INTEGER),
  i.model_name || '.' || i.field_name || ' (score: ' || CAST(total_score AS VARCHAR) || ')', total_score
FROM imp i JOIN (SELECT model_name, min(first_seq) AS model_seq FROM usage GROUP BY 1) m ON m.model_name = i.model_name
WHERE is_promoted
QUALIFY row_number() OVER (ORDER BY m.model_seq, total_score DESC, i.first_seq) <= 5""")
def q_usage_summary(spark, sf):
    u = ops.usage_counts(dv.usage_log(spark, sf))
    return ops.usage_summary(u, ops.field_importance(u, fx.key_fields(spark)))


# --- sync runs ---------------------------------------------------------------------------------------

def _duration_sql(ms: str) -> str:
    return f"""CASE WHEN {ms} < 1000 THEN CAST({ms} AS VARCHAR) || 'ms'
  WHEN {ms} < 60000 THEN CAST(floor(({ms} + 50) / 100) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(({ms} + 50) / 100) AS BIGINT) % 10 AS VARCHAR) || 's'
  WHEN {ms} < 3600000 THEN CAST(CAST(floor({ms} / 60000) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(({ms} % 60000 + 500) / 1000) AS BIGINT) AS VARCHAR) || 's'
  ELSE CAST(CAST(floor({ms} / 3600000) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor(({ms} % 3600000 + 30000) / 60000) AS BIGINT) AS VARCHAR) || 'm' END"""


@register("sync_run_metrics", o.with_ctes(dv.SYNC_RUNS_SQL) + f"""
, g AS (SELECT model_name, GROUPING(model_name) AS gid, count(*) AS syncs, count(*) FILTER (WHERE success) AS successful_syncs,
    sum(records_processed) AS records_processed, sum(records_embedded) AS records_embedded,
    sum(duration_ms) AS total_duration_ms, min(ts) AS first_sync, max(ts) AS last_sync
  FROM runs GROUP BY ROLLUP (model_name))
SELECT CASE WHEN gid = 1 THEN 'overall' ELSE 'model' END AS level, model_name, syncs, successful_syncs,
  syncs - successful_syncs AS failed_syncs, records_processed, records_embedded,
  records_processed - records_embedded AS records_failed, total_duration_ms,
  CAST(floor(total_duration_ms / syncs + 0.5) AS BIGINT) AS avg_duration_ms,
  CAST(CASE WHEN gid = 1 THEN floor(successful_syncs * 100 / syncs + 0.5)
            WHEN records_processed = records_embedded THEN 100
            ELSE floor(records_embedded * 100 / records_processed + 0.5) END AS BIGINT) AS success_rate,
  first_sync, last_sync,
  {_duration_sql("CASE WHEN gid = 1 THEN total_duration_ms ELSE CAST(floor(total_duration_ms / syncs + 0.5) AS BIGINT) END")} AS duration_text
FROM g""")
def q_sync_run_metrics(spark, sf):
    return ops.sync_run_metrics(dv.sync_runs(spark, sf))


# --- pairs ---------------------------------------------------------------------------------------------

def _pairs(spark, sf):
    """Pairs of customers and orders: both models are encoded with their
    timestamp carried along and decoded, each in one projection; texts are not cut."""
    c = _catalog(spark, sf)
    plan = codec.encoding_plan(cat.encoding_map(c))
    cust = (fx.record_view(spark, sf, "customer")
            .withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")))
    orders = fx.record_view(spark, sf, "orders").withColumn("ts", F.col("o_orderdate"))
    tables = codec.DecodeTables(cat.coord_lookup(c), plan)

    def decoded(records, model):
        enc = codec.encode_records(records, plan, model, keep=("ts",))
        return codec.decode_text(enc, tables, keep_all=True, text_cut=None, model=model)

    return ops.pairs(decoded(cust, "customer").unionByName(decoded(orders, "orders")), F.col("ts"))


def _pairs_order():
    return [F.desc("timestamp"), F.desc("model_name"), F.desc("record_id")]


def _pairs_sql() -> str:
    ctes = [o.catalog_cte(), o.LOOKUP_CTE]
    sel = []
    for m, ts in (("customer", "TIMESTAMP '2024-01-01 00:00:00' + e.record_id * INTERVAL 1 SECOND"),
                  ("orders", "x.o_orderdate")):
        ctes.append(f"enc_{m} AS ({o.encode_select(m)})")
        join = "JOIN orders x ON x.o_orderkey = e.record_id" if m == "orders" else ""
        sel.append(f"SELECT e.record_id, e.encoded_string AS input, d.decoded_text AS output, e.model_name, {ts} AS timestamp "
                   f"FROM enc_{m} e {join} JOIN dec_{m} d ON d.record_id = e.record_id")
    body = []
    for m in ("customer", "orders"):
        seg = o.SEGMENTS_CTE.replace("FROM enc)", f"FROM enc_{m})").replace("segs AS", f"segs_{m} AS") \
            .replace("FROM segs ", f"FROM segs_{m} ").replace("parsed AS", f"parsed_{m} AS")
        dts = o.decoded_text_select(False, text_cut=None).replace("FROM enc e", f"FROM enc_{m} e").replace("FROM parsed p", f"FROM parsed_{m} p")
        body += [seg, f"dec_{m} AS ({dts})"]
    return o.with_ctes(*ctes, *body, "pairs AS (" + "\nUNION ALL\n".join(sel) + ")") + ""


_PAIRS_BASE = _pairs_sql()


@register("keep_newest_n", _PAIRS_BASE + """
SELECT * FROM pairs WHERE output <> '' AND output <> '_No decodable fields found_'
ORDER BY timestamp DESC, model_name DESC, record_id DESC LIMIT 10000""")
def q_keep_newest_n(spark, sf):
    return ops.keep_newest(_pairs(spark, sf), ops.MAX_PAIRS, _pairs_order())


@register("pair_stats", _PAIRS_BASE + """
SELECT CASE WHEN GROUPING(model_name) = 1 THEN 'total' ELSE 'model' END AS level, model_name, count(*) AS n,
  min(timestamp) AS oldest, max(timestamp) AS newest
FROM pairs WHERE output <> '' AND output <> '_No decodable fields found_' GROUP BY ROLLUP (model_name)""")
def q_pair_stats(spark, sf):
    return ops.pair_stats(_pairs(spark, sf))


# --- tokens and query keys -----------------------------------------------------------------------------

@register("token_estimate", """
SELECT source, count(*) AS texts, sum(CAST(ceil(length(text) / 4) AS BIGINT)) AS tokens
FROM documents GROUP BY source""")
def q_token_estimate(spark, sf):
    return ops.token_costs(fx.read_table(spark, sf, "documents"), "text", "source")


@register("repeat_queries", f"""
SELECT count(*) AS requests, count(DISTINCT lower({o.js_trim('text')})) AS distinct_keys,
  round(1 - count(DISTINCT lower({o.js_trim('text')})) / count(*), 6) AS repeat_rate
FROM conversations WHERE role = 'user'""")
def q_repeat_queries(spark, sf):
    from ..functions.text import query_key

    ql = dv.query_log(spark, sf)
    key = query_key(js_trim(F.col("query")), F.lit("semantic"), F.lit(None).cast("string"),
                    F.array().cast("array<string>"), F.lit(10), F.lit(0.35), F.lit("schema"))
    return ops.repeat_rate(ql, key)


# --- error log, restrictions (E16, A15, P9, E5, I10) ----------------------------------------------------

from ..functions import text as tx  # noqa: E402


def _classified(spark, sf):
    return ops.classified_errors(dv.error_log(spark, sf))


def _classify_sql() -> str:
    L = o.lit
    msg = "replace(message, '\\n', chr(10))"
    section = f"regexp_extract({msg}, {L(tx.FIELDS_SECTION_RE)}, 1)"
    sec = f"regexp_extract_all({section}, {L(tx.FIELD_ITEM_RE)}, 1)"
    sec_alt = f"regexp_extract_all({msg}, {L(tx.FIELD_ALT_RE)}, 1)"
    comp_alt = f"regexp_extract_all({msg}, {L(tx.COMPUTE_ALT_RE)}, 1)"
    acc = (f"flatten(list_transform(regexp_extract_all({msg}, {L(tx.ACCESS_FIELDS_RE)}, 1), "
           f"lambda s: list_filter(regexp_split_to_array(s, '[,\\s]+'), lambda f: regexp_full_match(f, '\\w+'))))")
    is_sec = f"regexp_matches({msg}, {L(tx.SECURITY_RE)})"
    comp = f"regexp_matches({msg}, {L(tx.COMPUTE_RE)})"
    access = f"regexp_matches({msg}, {L(tx.ACCESS_RE)})"
    single = f"regexp_matches({msg}, {L(tx.SINGLETON_RE)})"
    hints = " OR ".join(f"regexp_matches(message, {L(h)})" for h in tx.RESTRICTION_HINTS)
    return f"""classified AS (SELECT error_id,
  CASE WHEN {is_sec} THEN 'security_restriction' WHEN {comp} THEN 'compute_error'
       WHEN {access} THEN 'security_restriction' WHEN {single} THEN 'singleton_error'
       WHEN len({comp_alt}) > 0 THEN 'compute_error' ELSE 'unknown' END AS error_type,
  CASE WHEN {is_sec} THEN nullif(trim(regexp_extract({msg}, {L(tx.DOC_MODEL_RE)}, 1)), '')
       WHEN {comp} THEN trim(regexp_extract({msg}, {L(tx.COMPUTE_RE)}, 1))
       WHEN {access} THEN nullif(trim(regexp_extract({msg}, {L(tx.ACCESS_MODEL_RE)}, 1)), '')
       WHEN {single} THEN trim(regexp_extract({msg}, {L(tx.SINGLETON_RE)}, 1)) END AS model,
  CASE WHEN {is_sec} THEN nullif(lower(regexp_extract({msg}, {L(tx.OPERATION_RE)}, 1)), '') END AS operation,
  CASE WHEN {is_sec} THEN (CASE WHEN len({sec}) > 0 THEN {sec} ELSE {sec_alt} END)
       WHEN {comp} THEN [regexp_extract({msg}, {L(tx.COMPUTE_RE)}, 2)]
       WHEN {access} THEN list_concat({comp_alt}, {acc})
       ELSE {comp_alt} END AS flist,
  {hints} AS is_restriction,
  regexp_matches(message, '(?i)Expected singleton') AS is_singleton
FROM elog)"""


@register("error_log_fields", o.with_ctes(dv.ERROR_LOG_SQL, _classify_sql()) + """
SELECT error_id, error_type, model, operation,
  array_to_string(list_sort(list_distinct(list_filter(flist, lambda x: x <> ''))), ',') AS fields,
  is_restriction, is_singleton FROM classified""")
def q_error_log_fields(spark, sf):
    c = _classified(spark, sf)
    return c.select("error_id", "error_type", "model", "operation",
                    F.array_join(F.array_sort("restricted_fields"), ",").alias("fields"),
                    "is_restriction", "is_singleton")


_RESTR_SQL = """restr AS (
  SELECT DISTINCT model AS model_name, unnest(list_distinct(list_filter(flist, lambda x: x <> ''))) AS field_name,
    CASE error_type WHEN 'compute_error' THEN 'compute_error' WHEN 'security_restriction' THEN 'security_restriction'
      WHEN 'singleton_error' THEN 'odoo_error' ELSE 'unknown' END AS reason
  FROM classified WHERE len(list_filter(flist, lambda x: x <> '')) > 0)"""


@register("restrictions_by_reason", o.with_ctes(dv.ERROR_LOG_SQL, _classify_sql(), _RESTR_SQL) + """
SELECT reason, field_name, count(DISTINCT model_name) AS n_models FROM restr GROUP BY reason, field_name""")
def q_restrictions_by_reason(spark, sf):
    return ops.restrictions_by_reason(ops.restrictions(_classified(spark, sf)))


def _restriction_dict(spark, sf, model: str) -> dict[str, str]:
    """One consistent restriction set for a run, limited to catalog fields of the model."""
    from ..operators.common import collect_bounded

    r = ops.restrictions(_classified(spark, sf)).filter(F.col("model_name") == model)
    fields = fx.catalog(spark, sf).filter(F.col("model_name") == model).select("field_name")
    r = r.join(fields, "field_name", "left_semi")
    # a field with several reasons: the source's own error first, the others by name
    r = r.groupBy("field_name").agg(F.min_by("reason", F.struct(F.col("reason") != ops.SOURCE_REASON, "reason")).alias("reason"))
    rows = collect_bounded(r, 100_000, "restricted fields")
    return {x["field_name"]: x["reason"] for x in rows}


_RESTR_FIELDS_SQL = """restr_f AS (SELECT model_name, field_name,
    CASE WHEN max(CASE WHEN reason = 'odoo_error' THEN 1 ELSE 0 END) = 1 THEN 'odoo_error' ELSE min(reason) END AS reason
  FROM restr GROUP BY model_name, field_name)"""


@register("encode_events_restricted",
          o.with_ctes(dv.ERROR_LOG_SQL, _classify_sql(), _RESTR_SQL, _RESTR_FIELDS_SQL)
          + o.encode_select("events", restricted="restr_f"))
def q_encode_events_restricted(spark, sf):
    """P9 + E5: restricted columns are not read; their value is the marker for the reason."""
    return codec.encode_records(fx.record_view(spark, sf, "events"), cat.encoding_map(_catalog(spark, sf)),
                                "events", restrictions=_restriction_dict(spark, sf, "events"))


# --- streaming (I2, I5, I6, I7, I9) ------------------------------------------------------------------------

from ..streaming import incremental as inc  # noqa: E402


@register("stream_usage_counts", o.with_ctes(dv.USAGE_LOG_SQL, _USAGE_SQL) + "SELECT * FROM usage")
def q_stream_usage_counts(spark, sf):
    """I5 as a stream over the events files (availableNow); equals the batch counts."""
    return inc.stream_usage_counts(spark, table_path(sf, "events"), dv.usage_from_events)


@register("stream_failed_rows", o.with_ctes(dv.FAILURE_LOG_SQL.replace(
    "UNION ALL\n  SELECT o_orderkey, 'orders', 6, 'embedding', o_orderpriority, CAST(trunc(o_orderkey / 500) AS INTEGER), '',\n"
    "    o_orderdate, o_orderkey + 1000000000\n  FROM orders WHERE o_orderstatus = 'P'", ""), _DLQ_SQL) + "SELECT * FROM dlq")
def q_stream_failed_rows(spark, sf):
    """I6 as a stream: keyed failed-row state from error events, all keys."""
    return inc.stream_failed_rows(spark, table_path(sf, "events"), dv.failures_from_events)


@register("stream_dedup_events", "SELECT * FROM events")
def q_stream_dedup_events(spark, sf):
    """Of repeated event ids the last written row stays (the test data has none; see the tests)."""
    return inc.stream_dedup(spark, table_path(sf, "events"), "event_id", "ts")


@register("stream_encode_orders", f"""
SELECT 6 * 10000000 + record_id AS id, record_id, model_name, encoded_string
FROM ({o.encode_select("orders")}) e""")
def q_stream_encode_orders(spark, sf):
    """Orders streamed through encode and embed into the point table (epoch deltas, last write wins)."""
    emap = cat.encoding_map(_catalog(spark, sf))

    def encode(stream):
        # the record view's computed column needs a join with lineitem: a
        # stream-static join on the order key
        counts = (fx.read_table(spark, sf, "lineitem").groupBy("l_orderkey")
                  .agg(F.count(F.lit(1)).alias("line_count")).withColumnRenamed("l_orderkey", "id"))
        recs = (stream.withColumnRenamed("o_orderkey", "id").join(counts, "id", "left")
                .withColumn("line_count", F.coalesce(F.col("line_count"), F.lit(0).cast("long"))))
        return codec.encode_records(recs, emap, "orders")

    def embed(pts_df):
        return vec.hashing_embed(pts_df, "encoded_string", dim=64)

    points, _failed, _runs = inc.stream_records(spark, table_path(sf, "orders"), encode, embed)
    return points.select("id", "record_id", "model_name", "encoded_string")


# --- record scans (S4-S8), vector attach (J7), unified search (V4), reports (E15, A3) -------------------

from ..sources import records as rec  # noqa: E402


@register("scan_records_domain", """
SELECT o_orderkey AS id, o_totalprice, o_orderdate FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def q_scan_records_domain(spark, sf):
    """Domain predicate and field list reach the Parquet scan."""
    dom = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return rec.scan_records(fx.record_view(spark, sf, "orders"), dom, ["id", "o_totalprice", "o_orderdate"])


@register("read_by_ids", """
SELECT c_custkey AS id, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_read_by_ids(spark, sf):
    """Records whose id is in another table's column (semi join, size-checked broadcast)."""
    ids = (fx.read_table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
           .select(F.col("o_custkey").alias("id")))
    return rec.read_by_ids(fx.record_view(spark, sf, "customer"), ids).select("id", "c_name")


def _doc_vectors(spark, sf):
    e = fx.read_table(spark, sf, "embeddings")
    return e.select((F.lit(fx.MODEL_IDS["documents"] * pts.MODEL_ID_MULTIPLIER) + F.col("vec_id")).alias("id"),
                    F.col("embedding").alias("vector"))


@register("vector_attach", """
SELECT 9 * 10000000 + d.doc_id AS id, d.doc_id AS record_id, e.vec_id IS NOT NULL AS has_vector
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_vector_attach(spark, sf):
    """Document points get their vector by id (a missing vector stays NULL; nothing shifts)."""
    p = pts.data_points(_encode(spark, sf, "documents"), _doc_vectors(spark, sf))
    return p.select("id", "record_id", F.col("vector").isNotNull().alias("has_vector"))


@register("vector_missing", """
SELECT d.doc_id AS record_id, 'documents' AS model_name, 'embedding' AS failure_stage
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def q_vector_missing(spark, sf):
    """J7 / K5 input: records without a vector become failed rows (stage embedding)."""
    p = pts.data_points(_encode(spark, sf, "documents"), _doc_vectors(spark, sf))
    return p.filter(F.col("vector").isNull()).select("record_id", "model_name",
                                                     F.lit("embedding").alias("failure_stage"))


@register("hit_report", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
SELECT id, model_name || '.' || field_name AS title,
  format('{{:,.1f}}', round(s * 100, 1)) || '%' AS score_text FROM (
  SELECT id, model_name, field_name, {_score_sql('v', 'qv')} AS s FROM p, q ORDER BY s DESC, id LIMIT 10) t
WHERE s >= 0.35""")
def q_hit_report(spark, sf):
    """Result columns of a search (score as percent, title)."""
    p = doc_points(spark, sf)
    hits = vec.knn_search(p, _first_vector(p), k=10, min_score=0.35)
    return hits.select("id", F.concat_ws(".", "model_name", "field_name").alias("title"),
                       tx.score_percent(F.col("score")).alias("score_text"))


@register("list_counts_by_type", o.with_ctes(o.seen_catalog_cte()) + """
SELECT field_type, count(*) AS n, string_agg(field_name, ',' ORDER BY field_name) AS fields
FROM catalog WHERE model_name = 'orders' GROUP BY field_type""")
def q_list_counts_by_type(spark, sf):
    """A3: grouped counts of a list result (by field type)."""
    return pts.counts_by(pts.list_fields(_points(spark, sf, _seen_catalog(spark, sf)), "orders"), "field_type")


# --- catalog loads (I3, I8) --------------------------------------------------------------------------------

@register("full_catalog_load", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT CAST(field_id AS BIGINT) AS id, 'schema' AS point_type, {_semantic_sql()} AS semantic_text, "
          "64 AS dims FROM catalog")
def q_full_catalog_load(spark, sf):
    """I3 + K2: catalog -> semantic text -> embed -> write a new point-table version, read back."""
    c = _seen_catalog(spark, sf)
    sp = vec.hashing_embed(pts.schema_points(c).drop("vector"), "semantic_text", dim=64)
    path = pts.write_points(pts.point_table(sp), scratch_path(spark, "points"))
    back = spark.read.parquet(path)
    return back.select("id", "point_type", "semantic_text", F.size("vector").alias("dims"))


@register("schema_hash", o.with_ctes(o.seen_catalog_cte()) +
          "SELECT 'v1-' || CAST(count(*) AS VARCHAR) || '-' || CAST(count(DISTINCT model_name) AS VARCHAR) AS schema_hash "
          "FROM catalog")
def q_schema_hash(spark, sf):
    """I8: the schema hash that keys usage state; state under another hash is rebuilt."""
    return chg.schema_hash(_seen_catalog(spark, sf))


@register("incremental_catalog_load", o.with_ctes(o.seen_catalog_cte()) +
          f"SELECT CAST(field_id AS BIGINT) AS id, {_semantic_sql()} AS semantic_text, 64 AS dims FROM catalog")
def q_incremental_catalog_load(spark, sf):
    """I4: previous points = an older catalog (no benchmark model, other part labels,
    one field since removed); the incremental load must equal a full load."""
    from ..operators import sync

    def embed(df):
        return vec.hashing_embed(df, "semantic_text", dim=64)

    c = _seen_catalog(spark, sf)
    old_cat = c.filter(F.col("model_name") != "benchmark").withColumn(
        "field_label", F.when(F.col("model_name") == "part", F.upper("field_label")).otherwise(F.col("field_label")))
    gone = c.filter(F.col("field_id") == 101).withColumn("field_id", F.lit(9999))
    previous = sync.full_catalog_load(old_cat.unionByName(gone), embed)
    res = sync.incremental_catalog_load(c, previous, embed)
    return res.points.select("id", "semantic_text", F.size("vector").alias("dims"))


@register("filtered_count", o.with_ctes(o.seen_catalog_cte()) +
          "SELECT count(*) AS n FROM catalog WHERE model_name = 'orders' AND field_type IN ('integer', 'monetary')")
def q_filtered_count(spark, sf):
    """A4: count of points matching a payload filter."""
    return pts.filtered_count(_points(spark, sf, _seen_catalog(spark, sf)), pts.payload_filter("orders", ["integer", "monetary"]))


@register("usage_capped", o.with_ctes(dv.USAGE_LOG_SQL, _USAGE_SQL) +
          "SELECT * FROM usage ORDER BY last_used DESC, model_name, field_name LIMIT 50")
def q_usage_capped(spark, sf):
    """The usage table keeps the most recently used entries (cap 50 here to make it bite)."""
    return ops.cap_usage(ops.usage_counts(dv.usage_log(spark, sf)), 50)


@register("dlq_remove_retried", o.with_ctes(dv.FAILURE_LOG_SQL, _DLQ_SQL) + """
SELECT * FROM dlq d WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT'
    AND d.model_name = 'orders' AND d.record_id = o.o_orderkey)""")
def q_dlq_remove_retried(spark, sf):
    """K6: keys retried successfully (urgent pending orders) leave the failed-row table."""
    dlq = ops.merge_failures(dv.failure_log(spark, sf))
    ok = (fx.read_table(spark, sf, "orders")
          .filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
          .select(F.lit("orders").alias("model_name"), F.col("o_orderkey").alias("record_id")))
    return ops.remove_failures(dlq, ok)


# --- one search over catalog and records (V4, W4, J2, E15) --------------------------------------------------

from ..operators import search as srch  # noqa: E402

_SEARCH_TEXT, _SEARCH_MODELS, _WORD_DIMS = "customer account balance mktsegment BUILDING field", ("customer", "supplier", "part", "nation"), 64


def _search_points(spark, sf, c, plan):
    """Schema points and the records of four models, embedded word by word and stored."""
    both = pts.point_table(pts.schema_points(c), *[pts.data_points(_encode(spark, sf, m, plan=plan)) for m in _SEARCH_MODELS])
    both = both.withColumn("vector", srch.word_embed(F.coalesce("encoded_string", "semantic_text"), _WORD_DIMS))
    return spark.read.parquet(pts.write_points(both, scratch_path(spark, "search-points")))


def _search(spark, sf, point_type):
    from ..operators.common import collect_bounded

    c = _catalog(spark, sf)
    plan = codec.encoding_plan(cat.encoding_map(c))
    imp = ops.field_importance(ops.usage_counts(dv.usage_log(spark, sf)), fx.key_fields(spark))
    rows = collect_bounded(ops.adaptive_key_fields(imp, fx.key_fields(spark), ["events", "customer"]), 1_000_000, "key fields")
    keys: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        keys.setdefault(r["model_name"], []).append(r["field_name"])
    vector = spark.range(1).select(srch.word_embed(F.lit(_SEARCH_TEXT), _WORD_DIMS).alias("v")).first()["v"]
    return srch.hits(_search_points(spark, sf, c, plan), [float(x) for x in vector], codec.DecodeTables(cat.coord_lookup(c), plan), keys,
                     k=15, min_score=0.2, pred=pts.payload_filter(point_type=point_type))


def _word_vector_sql(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9_]+'), lambda w: w <> '')"
    at = f"list_transform({words}, lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS INTEGER) % {_WORD_DIMS})"
    return f"list_transform(range({_WORD_DIMS}), lambda i: CAST(len(list_filter({at}, lambda b: b = i)) AS DOUBLE))"


def _search_sql(point_type: str) -> str:
    enc = "enc AS (" + "\nUNION ALL\n".join(o.encode_select(m) for m in _SEARCH_MODELS) + ")"
    keys = """adaptive AS (SELECT model_name, field_name FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY grp, o1, o2, field_name) AS rank FROM (
    SELECT model_name, field_name, 0 AS grp, CAST(key_rank AS DOUBLE) AS o1, CAST(0 AS BIGINT) AS o2 FROM kfr
    UNION ALL SELECT model_name, field_name, 1, -total_score, first_seq FROM imp WHERE is_promoted) b
  WHERE model_name IN ('events', 'customer')) t WHERE rank <= 12)"""
    kind = {"all": "TRUE", "data": "is_data", "schema": "NOT is_data"}[point_type]
    decoded = o.decoded_select(False) + """
WHERE (p.model_name, p.record_id) IN (SELECT (model_name, record_id) FROM best WHERE is_data)
  AND (p.model_name NOT IN (SELECT model_name FROM adaptive) OR (p.model_name, l.field_name) IN (SELECT (model_name, field_name) FROM adaptive))"""
    return o.with_ctes(o.catalog_cte(), o.LOOKUP_CTE, enc, o.SEGMENTS_CTE, dv.USAGE_LOG_SQL, _USAGE_SQL, o.key_fields_cte(), _IMPORTANCE_SQL,
                       _kf_rank_cte(), keys, f"""pt AS (
  SELECT CAST(model_id AS BIGINT) * 10000000 + record_id AS id, TRUE AS is_data, model_name, record_id, encoded_string AS txt, NULL AS field_name FROM enc
  UNION ALL SELECT CAST(field_id AS BIGINT), FALSE, model_name, NULL, {_semantic_sql()}, field_name FROM catalog)""",
                       f"emb AS (SELECT *, {_word_vector_sql('txt')} AS v FROM pt WHERE {kind})",
                       f"q AS (SELECT {_word_vector_sql(o.lit(_SEARCH_TEXT))} AS qv)",
                       f"""best AS (SELECT * FROM (SELECT emb.*, {_score_sql('v', 'qv')} AS s FROM emb, q ORDER BY s DESC, id LIMIT 15) t WHERE s >= 0.2)""",
                       f"shown AS ({decoded})",
                       """lines AS (SELECT model_name, record_id, string_agg('- **' || field_label || ':** ' || display_value, chr(10) ORDER BY pos) AS txt
  FROM shown GROUP BY 1, 2)""")


def _search_report_sql(point_type: str) -> str:
    return _search_sql(point_type) + """
SELECT CAST(row_number() OVER (ORDER BY b.s DESC, b.id) AS INTEGER) AS rank, b.id, CASE WHEN b.is_data THEN 'DATA' ELSE 'SCHEMA' END AS kind,
  CASE WHEN b.is_data THEN b.model_name || ' #' || b.record_id ELSE b.model_name || '.' || b.field_name END AS title,
  format('{:,.1f}', round(b.s * 100, 1)) || '%' AS score_text,
  CASE WHEN NOT b.is_data AND c.field_type = 'many2one' THEN 'Relates to: ' || regexp_replace(c.primary_data_location, '\\.id$', '')
       WHEN NOT b.is_data AND c.field_type IN ('one2many', 'many2many') THEN 'Related location: ' || c.primary_data_location END AS relation,
  CASE WHEN b.is_data THEN coalesce(lines.txt, '*No decodable key fields found*')
       ELSE concat_ws(chr(10), 'Label: ' || c.field_label, 'Type: ' || c.field_type, 'Primary Data Location: ' || c.primary_data_location,
                      'Stored: ' || CASE WHEN c.stored THEN 'Yes' ELSE 'No (Computed)' END,
                      'IDs: Model ' || c.primary_model_id || ' | Field ' || c.primary_field_id) END AS details,
  CASE WHEN b.is_data THEN b.txt END AS encoded_string
FROM best b LEFT JOIN catalog c ON NOT b.is_data AND c.field_id = b.id
LEFT JOIN lines ON b.is_data AND lines.model_name = b.model_name AND lines.record_id = b.record_id"""


@register("search_all", _search_report_sql("all"))
def q_search_all(spark, sf):
    """One search over catalog fields and records, as report rows."""
    return srch.report(_search(spark, sf, "all"))


@register("search_records", _search_report_sql("data"))
def q_search_records(spark, sf):
    """The same search over records only: key fields decoded for the hits."""
    return srch.report(_search(spark, sf, "data"))


@register("search_fields", _search_report_sql("schema"))
def q_search_fields(spark, sf):
    """The same search over catalog fields only."""
    return srch.report(_search(spark, sf, "schema"))


@register("search_usage", _search_sql("data") + "SELECT model_name, field_name, 'decode' AS context, count(*) AS n FROM shown GROUP BY 1, 2")
def q_search_usage(spark, sf):
    """Usage rows of the record search, counted by field (what A9 takes in)."""
    return srch.usage_rows(_search(spark, sf, "data")).groupBy("model_name", "field_name", "context").agg(F.count(F.lit(1)).alias("n"))


@register("search_summary", _search_sql("all") + """
SELECT count(*) AS hits, count(*) FILTER (WHERE NOT is_data) AS schema_hits, count(*) FILTER (WHERE is_data) AS data_hits FROM best""")
def q_search_summary(spark, sf):
    """Counts at the head of the report."""
    return srch.summary(_search(spark, sf, "all"))


# --- record sync as one plan (I1, I2, J7, K1, K4, K5, K6, I9) -----------------------------------------------

from ..streaming.record_sync import RecordSync  # noqa: E402


def _synced_orders(spark, sf) -> RecordSync:
    """Three incremental runs over orders: up to the first date, up to the second with rows that repeat, and all of them,
    where every seventh order has changed since; every eleventh gets no vector."""
    plan = codec.encoding_plan(cat.encoding_map(_catalog(spark, sf)))
    # the source as it is, written once: each run reads it again, and would count the lines of all orders again
    source = scratch_path(spark, "sync-source")
    fx.record_view(spark, sf, "orders").write.parquet(source)
    orders = spark.read.parquet(source).withColumn("write_date", F.col("o_orderdate"))
    later = F.col("id") % 7 == 0
    first = orders.withColumn("o_orderpriority", F.when(later, F.lit("OLD")).otherwise(F.col("o_orderpriority")))
    last = orders.withColumn("write_date", F.when(later, F.expr("write_date + INTERVAL 10 YEARS")).otherwise(F.col("write_date")))

    def embed(text):
        order = F.regexp_extract(text, r"^\d+\^\d+\*(\d+)", 1).cast("long")
        return F.when(order % 11 != 0, srch.word_embed(text, 16))

    sync = RecordSync(spark, "orders", lambda rows: codec.encode_records(rows, plan, "orders", keep=("write_date",)), embed)
    sync.load(first.filter(F.col("o_orderdate") <= F.lit(dv.SYNC_DATES[0]).cast("timestamp_ntz")), 0)
    second = chg.incremental_rows(first.filter(F.col("o_orderdate") <= F.lit(dv.SYNC_DATES[1]).cast("timestamp_ntz")), sync.mark(0), "write_date")
    stale = second.filter(F.col("id") % 5 == 0).withColumns({"o_orderpriority": F.lit("REPEAT"), "write_date": F.expr("write_date - INTERVAL 1 HOUR")})
    sync.apply(second.unionByName(stale), 1)
    sync.load(last, 2)
    return sync


_SYNC_1, _SYNC_2 = (f"TIMESTAMP '{d}'" for d in dv.SYNC_DATES)


@register("record_sync_points", "SELECT 6 * 10000000 + record_id AS id, record_id, encoded_string FROM ("
          + o.encode_select("orders", where="o_orderkey % 11 <> 0") + ") e")
def q_record_sync_points(spark, sf):
    """Points after three runs equal a full rebuild."""
    return _synced_orders(spark, sf).read("points", 2).select("id", "record_id", "encoded_string")


@register("record_sync_failures", f"""
SELECT o_orderkey AS record_id, 'embedding' AS failure_stage, CAST(2 AS INTEGER) AS last_batch,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderdate <= {_SYNC_2} THEN 1 ELSE 0 END AS retry_count
FROM orders WHERE o_orderkey % 11 = 0 AND (o_orderkey % 7 = 0 OR o_orderdate > {_SYNC_2})
UNION ALL
SELECT o_orderkey, 'embedding', CASE WHEN o_orderdate <= {_SYNC_1} THEN 0 ELSE 1 END, 0
FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 AND o_orderdate <= {_SYNC_2}""")
def q_record_sync_failures(spark, sf):
    """Failed rows after three runs, with the run they last failed in."""
    f = _synced_orders(spark, sf).read("failures", 2)
    return f.select("record_id", "failure_stage", F.col("batch_number").alias("last_batch"), "retry_count")


@register("record_sync_runs", f"""
WITH loaded AS (
  SELECT 0 AS batch, o_orderkey AS k, 1 AS n FROM orders WHERE o_orderdate <= {_SYNC_1}
  UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END FROM orders WHERE o_orderdate > {_SYNC_1} AND o_orderdate <= {_SYNC_2}
  UNION ALL SELECT 2, o_orderkey, 1 FROM orders WHERE o_orderdate > {_SYNC_2} OR o_orderkey % 7 = 0)
SELECT CAST(batch AS BIGINT) AS batch, CAST(sum(n) AS BIGINT) AS records_processed, count(*) FILTER (WHERE k % 11 <> 0) AS records_embedded,
  count(*) FILTER (WHERE k % 11 = 0) AS records_failed, count(*) FILTER (WHERE k % 11 = 0) = 0 AS success
FROM loaded GROUP BY batch""")
def q_record_sync_runs(spark, sf):
    """The run rows of the three runs."""
    return _synced_orders(spark, sf).runs().drop("duration_ms")


@register("semantic_search_schema", o.with_ctes(o.seen_catalog_cte(), f"emb AS (SELECT *, {_word_vector_sql(_semantic_sql())} AS v FROM catalog)",
                                                f"q AS (SELECT {_word_vector_sql(o.lit('customer account balance monetary'))} AS qv)") + f"""
SELECT id, model_name, field_name, score FROM (
  SELECT CAST(field_id AS BIGINT) AS id, model_name, field_name, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s
  FROM emb, q ORDER BY s DESC, id LIMIT 10) t WHERE s >= 0.0""")
def q_semantic_search_schema(spark, sf):
    """V4 over the catalog's points: a sentence against their semantic texts."""
    sp = pts.schema_points(_seen_catalog(spark, sf)).withColumn("vector", srch.word_embed(F.col("semantic_text"), _WORD_DIMS))
    q = spark.range(1).select(srch.word_embed(F.lit("customer account balance monetary"), _WORD_DIMS).alias("v")).first()["v"]
    return vec.knn_search(sp, [float(x) for x in q], k=10, min_score=0.0).select("id", "model_name", "field_name",
                                                                                 F.round("score", 6).alias("score"))


@register("unified_search", o.with_ctes(DOC_POINTS_SQL, o.seen_catalog_cte(), "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)", f"""both_ AS (
  SELECT 'data' AS point_type, id, v FROM p
  UNION ALL SELECT 'schema', CAST(field_id AS BIGINT), {_word_vector_sql(_semantic_sql())} FROM catalog)""") + f"""
SELECT point_type, count(*) AS hits FROM (
  SELECT point_type, {_score_sql('v', 'qv')} AS s FROM both_, q ORDER BY s DESC, id LIMIT 20) t WHERE s >= 0.0 GROUP BY point_type""")
def q_unified_search(spark, sf):
    """V4: one search over data and schema points (point_type all), hits counted per type."""
    sp = pts.schema_points(_seen_catalog(spark, sf)).withColumn("vector", srch.word_embed(F.col("semantic_text"), _WORD_DIMS))
    docs = doc_points(spark, sf)
    hits = vec.knn_search(pts.point_table(sp, docs), _first_vector(docs), k=20, min_score=0.0, pred=pts.payload_filter(point_type="all"))
    return hits.groupBy("point_type").agg(F.count(F.lit(1)).alias("hits"))


# --- malformed segments (S3), hybrid search (X1) -------------------------------------------------------------

from ..operators import hybrid  # noqa: E402


def _damaged_customers(spark, sf):
    """Encoded customers, some of them damaged by rule: separators lost, letters in ids, a foreign tail."""
    bad, text = F.col("record_id") % 10, F.col("encoded_string")
    broken = (F.when(bad == 1, F.replace(text, F.lit("3^302*"), F.lit("3^302")))
              .when(bad == 2, F.replace(text, F.lit("3^304*"), F.lit("3^30x*")))
              .when(bad == 3, F.concat(text, F.lit("|tail|  |a^1*v")))
              .when(bad == 4, F.replace(text, F.lit("3^305*"), F.lit("3305*"))).otherwise(text))
    return _encode(spark, sf, "customer").withColumn("encoded_string", broken)


_DAMAGED_SQL = o.with_ctes("whole AS (" + o.encode_select("customer") + ")", """enc AS (
  SELECT record_id, model_name, CASE record_id % 10 WHEN 1 THEN replace(encoded_string, '3^302*', '3^302')
    WHEN 2 THEN replace(encoded_string, '3^304*', '3^30x*') WHEN 3 THEN encoded_string || '|tail|  |a^1*v'
    WHEN 4 THEN replace(encoded_string, '3^305*', '3305*') ELSE encoded_string END AS encoded_string FROM whole)""", o.SEGMENTS_CTE)


@register("malformed_segments", _DAMAGED_SQL + f"""
SELECT record_id, model_name, CAST(pos AS INTEGER) AS pos, seg,
  CASE WHEN strpos(seg, '*') = 0 THEN 'no value separator'
       WHEN strpos(string_split(seg, '*')[1], '^') = 0 THEN 'no coordinate separator'
       WHEN NOT regexp_full_match(string_split(seg, '^')[1], '[0-9]+') THEN 'model id is not a number'
       ELSE 'field id is not a number' END AS reason
FROM segs WHERE seg <> '' AND NOT regexp_matches(seg, '{o.SEGMENT_RE}')""")
def q_malformed_segments(spark, sf):
    """S3: what decoding can't read, with place and reason."""
    return codec.quarantine_segments(_damaged_customers(spark, sf), scratch_path(spark, "segments"))[1]


@register("well_formed_segments", _DAMAGED_SQL + f"""
SELECT record_id, model_name, CAST(pos AS INTEGER) AS pos, seg FROM segs WHERE seg <> '' AND regexp_matches(seg, '{o.SEGMENT_RE}')""")
def q_well_formed_segments(spark, sf):
    """The other output of the same scan."""
    return codec.quarantine_segments(_damaged_customers(spark, sf), scratch_path(spark, "segments"))[0]


@register("hybrid_search", f"""
WITH words AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
posts AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words) x GROUP BY 1, 2),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
wanted AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
scored AS (SELECT p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({hybrid.K1} + 1)
    / (tf + {hybrid.K1} * (1 - {hybrid.B} + {hybrid.B} * len(w) / mean))), 9) AS score
  FROM posts p JOIN wanted USING (term) JOIN dfs USING (term) JOIN words ON words.id = p.id, totals GROUP BY p.id),
bw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS word_rank FROM scored QUALIFY word_rank <= 50),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
sv AS (SELECT vec_id AS id, {_score_sql('CAST(embedding AS DOUBLE[])', 'qv')} AS s FROM embeddings, q),
bv AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM sv QUALIFY vector_rank <= 50)
SELECT coalesce(bw.id, bv.id) AS id, CAST(word_rank AS INTEGER) AS word_rank, CAST(vector_rank AS INTEGER) AS vector_rank,
  round(coalesce(1.0 / ({hybrid.FUSION} + word_rank), 0) + coalesce(1.0 / ({hybrid.FUSION} + vector_rank), 0), 9) AS score
FROM bw FULL JOIN bv ON bw.id = bv.id ORDER BY coalesce(1.0 / ({hybrid.FUSION} + word_rank), 0) + coalesce(1.0 / ({hybrid.FUSION} + vector_rank), 0) DESC, id LIMIT 20""")
def q_hybrid_search(spark, sf):
    """The words of the first benchmark item against the documents' words, the first vector against theirs, fused."""
    path = hybrid.text_index(fx.read_table(spark, sf, "documents"), id_col="doc_id")
    item = fx.read_table(spark, sf, "benchmark").agg(F.min_by(hybrid.terms(F.col("text")), "item_id").alias("w")).first()["w"]
    e = fx.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = hybrid.ranked(vec.knn_search(e, _first_vector(e), k=50, min_score=-1.0).select("id", "score"), 50)
    hits = hybrid.fuse(hybrid.bm25(spark, path, item, 50), near, 20)
    return hits.select("id", "word_rank", "vector_rank", F.round("score", 9).alias("score"))


# --- sign bits (X2), search analytics (X3), data age (A11), warnings (I10), reports and scans on data -----------

from ..operators import search_log as slog  # noqa: E402


def _sign_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x > 0)"


@register("knn_sign_bits", o.with_ctes(DOC_POINTS_SQL, "q AS (SELECT v AS qv FROM p ORDER BY id LIMIT 1)") + f"""
, c AS (SELECT id, model_name, v, qv, len(list_filter(list_zip({_sign_sql('v')}, {_sign_sql('qv')}), lambda z: z[1] <> z[2])) AS away
  FROM p, q ORDER BY away, id LIMIT 30)
SELECT id, model_name, score FROM (
  SELECT id, model_name, round({_score_sql('v', 'qv')}, 6) AS score, {_score_sql('v', 'qv')} AS s FROM c ORDER BY s DESC, id LIMIT 10) t
WHERE s >= 0.0""")
def q_knn_sign_bits(spark, sf):
    """X2 over stored sign bits: Hamming distance chooses 30 rows, an exact rescore 10."""
    p = doc_points(spark, sf)
    path = vix.write_sign_bits(p, scratch_path(spark, "sign-bits"), dim=64)
    hits = vix.knn_sign_bits(spark, path, _first_vector(p), k=10, min_score=0.0)
    return hits.select("id", "model_name", F.round("score", 6).alias("score"))


@register("search_volume", o.with_ctes(dv.SEARCH_LOG_SQL) + """
SELECT mode, count(*) AS requests, count(*) FILTER (WHERE results = 0) AS zero_results,
  round(count(*) FILTER (WHERE results = 0) / count(*), 6) AS zero_rate, round(avg(score), 6) AS mean_score
FROM slog GROUP BY mode""")
def q_search_volume(spark, sf):
    """Volume, zero-result rate and mean score by mode, from merged daily rows."""
    rows = slog.report(slog.daily(dv.search_log(spark, sf)), "mode")
    return rows.select("mode", "requests", "zero_results", F.round("zero_rate", 6).alias("zero_rate"), F.round("mean_score", 6).alias("mean_score"))


@register("search_latency", o.with_ctes(dv.SEARCH_LOG_SQL) + """
SELECT CAST(ts AS DATE) AS day, mode, count(*) AS requests, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM slog GROUP BY 1, 2""")
def q_search_latency(spark, sf):
    """Exact latency quantiles per day and mode (the sketches are tested against them)."""
    rows = slog.exact_report(dv.search_log(spark, sf), "day", "mode")
    return rows.select("day", "mode", "requests", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@register("search_latency_within_bound", o.with_ctes(dv.SEARCH_LOG_SQL) + "SELECT mode, TRUE AS p50, TRUE AS p95, TRUE AS p99 FROM slog GROUP BY mode")
def q_search_latency_within_bound(spark, sf):
    """Whether each merged sketch's quantile lies between the exact ones 2 % of the ranks below and above."""
    log = dv.search_log(spark, sf)
    low = [F.percentile("latency_ms", max(0.0, q - 0.02)).alias(f"low{i}") for i, q in enumerate(slog.QUANTILES)]
    high = [F.percentile("latency_ms", min(1.0, q + 0.02)).alias(f"high{i}") for i, q in enumerate(slog.QUANTILES)]
    both = slog.report(slog.daily(log), "mode").join(log.groupBy("mode").agg(*low, *high), "mode")
    return both.select("mode", *[F.col(f"p{int(q * 100)}").between(F.col(f"low{i}"), F.col(f"high{i}")).alias(f"p{int(q * 100)}")
                                 for i, q in enumerate(slog.QUANTILES)])


@register("usage_age", o.with_ctes(dv.USAGE_LOG_SQL) + """
SELECT 'age_hours' AS kind, 0 AS rank, CAST(NULL AS VARCHAR) AS item,
  floor(epoch_us(TIMESTAMP '2024-03-01 12:00:00' - min(ts)) / 3.6e9 + 0.5) AS value FROM ulog""")
def q_usage_age(spark, sf):
    """Age of the usage data, as of a given time."""
    return ops.data_age(dv.usage_log(spark, sf), F.lit("2024-03-01 12:00:00").cast("timestamp_ntz"))


@register("run_warnings", o.with_ctes(dv.ERROR_LOG_SQL, _classify_sql(), _RESTR_SQL) + """
, w AS (SELECT *, row_number() OVER (ORDER BY model_name NULLS FIRST, field_name, reason) AS rank FROM restr)
SELECT CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 100 THEN model_name END AS model_name,
  CASE WHEN rank > 100 THEN '... and more warnings (truncated at 100)'
       ELSE 'Field ''' || field_name || ''' restricted (' || reason || ') - marked as ' ||
         CASE reason WHEN 'odoo_error' THEN 'Restricted_odoo_error' ELSE 'Restricted_from_API' END END AS warning
FROM w WHERE rank <= 101""")
def q_run_warnings(spark, sf):
    """The warnings that restricted fields add to a run's result."""
    return ops.run_warnings(ops.restrictions(_classified(spark, sf)))


@register("alignment_summary", o.with_ctes("al AS (" + _alignment_sql() + ")") + """
SELECT model_name, count(*) FILTER (WHERE status = 'matched') AS matched,
  count(*) FILTER (WHERE status = 'missing_in_schema') AS missing_in_schema,
  count(*) FILTER (WHERE status = 'missing_in_source') AS missing_in_source,
  count(*) FILTER (WHERE status = 'missing_in_schema') = 0 AS valid FROM al GROUP BY model_name""")
def q_alignment_summary(spark, sf):
    """Per model, columns matched and missing on either side."""
    return cat.alignment_summary(cat.column_alignment(_alignment_columns(spark, sf), _seen_catalog(spark, sf)))


@register("export_pairs", _PAIRS_BASE + "SELECT input, output, model_name, timestamp FROM pairs "
          "WHERE output <> '' AND output <> '_No decodable fields found_'")
def q_export_pairs(spark, sf):
    """K7: all pairs written as JSON lines and read back."""
    path = ops.export_pairs(_pairs(spark, sf), scratch_path(spark, "pairs"))
    return spark.read.schema("input string, output string, model_name string, timestamp timestamp_ntz").json(path)


@register("scan_active", "SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal >= 0")
def q_scan_active(spark, sf):
    """The archived switch; customers in debt count as archived."""
    records = fx.record_view(spark, sf, "customer").withColumn("active", F.col("c_acctbal") >= 0)
    return rec.scan_records(records, fields=["id", "c_name"], include_archived=False)


@register("scan_leads", """
SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice AS expected_revenue, o_orderdate AS create_date,
  o_orderstatus <> 'F' AS active, o_custkey AS partner_id
FROM orders WHERE o_orderstatus <> 'P'""")
def q_scan_leads(spark, sf):
    """The fixed field list of opportunities, archived ones included; pending orders are plain leads."""
    o_ = fx.read_table(spark, sf, "orders")
    leads = o_.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("expected_revenue"),
                      F.col("o_orderdate").alias("create_date"), (F.col("o_orderstatus") != "F").alias("active"),
                      F.col("o_custkey").alias("partner_id"),
                      F.when(F.col("o_orderstatus") == "P", F.lit("lead")).otherwise(F.lit("opportunity")).alias("type"))
    return rec.scan_leads(leads)


_LETTERS = "aeiou"


def _vowel_counts(texts: list[str]):
    import numpy as np

    return np.array([[t.count(c) for c in _LETTERS] for t in texts], dtype=np.float32).reshape(len(texts), len(_LETTERS))


@register("embed_batches", "SELECT doc_id AS id, " + ", ".join(
    f"CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')) AS FLOAT) AS {c}" for c in _LETTERS) + " FROM documents")
def q_embed_batches(spark, sf):
    """V7: a user's batch embedder (here: counts of vowels) over all documents, a batch of texts at a time."""
    embed = vec.udf_embedder(_vowel_counts, len(_LETTERS))
    d = fx.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), embed(F.col("text")).alias("v"))
    return d.select("id", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(_LETTERS)])


_ODD_FIELDS = (("id", "integer"), ("long_text", "boolean"), ("topic_ids", "many2many"), ("source_id", "many2one"), ("parts", "one2many"))


@register("encode_list_fields", """
SELECT doc_id AS record_id, '7^1*' || doc_id || '|7^2*' || CASE WHEN n_chars > 2000 THEN 'TRUE' ELSE 'FALSE' END ||
  '|7^3*[' || CASE WHEN n_chars % 3 = 0 THEN '' ELSE n_chars % 3 || ',' || doc_id % 5 END || ']' ||
  '|8^1*' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 4 AS VARCHAR) END ||
  '|7^5*' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '[' || doc_id % 2 || ']' END AS encoded_string
FROM documents""")
def q_encode_list_fields(spark, sf):
    """Boolean, list and pair values, present and absent, of all documents."""
    n, key = F.col("n_chars"), F.col("doc_id")
    docs = fx.read_table(spark, sf, "documents").select(
        key.alias("id"), (n > 2000).alias("long_text"),
        F.when(n % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 3, key % 5)).alias("topic_ids"),
        F.when(key % 4 != 0, F.struct((key % 4).alias("id"), F.col("source").alias("name"))).alias("source_id"),
        F.when(key % 2 != 0, F.array(key % 2)).alias("parts"))
    plan = {"document": [{"field_name": name, "field_type": kind, "prefix": "8^1" if name == "source_id" else f"7^{i}", "model_id": 7, "line_no": i}
                         for i, (name, kind) in enumerate(_ODD_FIELDS, start=1)]}
    return codec.encode_records(docs, plan, "document").select("record_id", "encoded_string")
