"""DuckDB SQL for the oracle check: the same rules as the Spark operators,
written independently in plain SQL over the driver's views.

Only text generation lives here; the SQL is run by the driver (and by our
tests) with DuckDB on the same Parquet tables.
"""

from __future__ import annotations

from ..functions.codec import FLOAT_PREFIX, INT_PREFIX, JS_SPACE, NO_FIELDS_TEXT, TRIM_PATTERN
from . import fixture as fx

SEGMENT_RE = r"(?s)^(\d+)\^(\d+)\*(.*)$"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def catalog_cte(exclude_models: tuple[str, ...] = ()) -> str:
    rows = fx.catalog_rows(exclude_models)
    cols = ["line_no", "model_id", "field_id", "field_name", "field_label", "field_type",
            "model_name", "primary_data_location", "stored", "primary_model_id", "primary_field_id"]
    values = ",\n".join("(" + ", ".join(lit(r[c]) for c in cols) + ")" for r in rows)
    return (f"catalog AS (SELECT CAST(line_no AS BIGINT) AS line_no, CAST(model_id AS INTEGER) AS model_id, "
            f"CAST(field_id AS INTEGER) AS field_id, field_name, field_label, field_type, model_name, "
            f"primary_data_location, stored, primary_model_id, primary_field_id "
            f"FROM (VALUES {values}) AS t({', '.join(cols)}))")


def catalog_line_cte(exclude_models: tuple[str, ...] = ()) -> str:
    rows = fx.catalog_rows(exclude_models)
    values = ",\n".join(f"({r['line_no']}, {lit(fx.catalog_line(r))})" for r in rows)
    return f"catalog_text AS (SELECT CAST(line_no AS BIGINT) AS line_no, value FROM (VALUES {values}) AS t(line_no, value))"


def seen_cte() -> str:
    """Columns of the tables that hold a value in some row."""
    parts = []
    for m, cols in fx.TABLE_COLUMNS.items():
        parts += [f"SELECT {lit(m)} AS m, {lit('id' if c == fx.KEY_COLUMNS.get(m) else c)} AS f FROM {m} HAVING count({c}) > 0" for c, _ in cols]
    return "seen AS (" + "\nUNION ALL\n".join(parts) + ")"


def seen_catalog_cte(exclude_models: tuple[str, ...] = ()) -> str:
    """The catalog without the columns that hold no value."""
    listed = catalog_cte(exclude_models).replace("catalog AS (", "listed AS (", 1)
    return f"{listed},\n{seen_cte()},\ncatalog AS (SELECT * FROM listed WHERE NOT stored OR (model_name, field_name) IN (SELECT (m, f) FROM seen))"


def seen_line_cte() -> str:
    listed = ",\n".join(f"({r['line_no']}, {lit(fx.catalog_line(r))}, {lit(r['model_name'])}, {lit(r['field_name'])}, {lit(r['stored'])})"
                        for r in fx.catalog_rows())
    return (f"{seen_cte()},\ncatalog_text AS (SELECT CAST(line_no AS BIGINT) AS line_no, value FROM (VALUES {listed}) AS t(line_no, value, m, f, stored) "
            f"WHERE NOT stored OR (m, f) IN (SELECT (m, f) FROM seen))")


EMAP_CTE = """emap AS (
  SELECT model_name, model_id, field_name, line_no, field_id, field_type,
    CASE WHEN field_type = 'many2one' THEN primary_model_id || '^' || primary_field_id
         ELSE CAST(model_id AS VARCHAR) || '^' || CAST(field_id AS VARCHAR) END AS prefix,
    field_type IN ('many2one', 'one2many', 'many2many') AS is_foreign_key,
    CASE WHEN field_type IN ('many2one', 'one2many', 'many2many')
         THEN regexp_replace(primary_data_location, '\\.id$', '') END AS target_model
  FROM catalog)"""

LOOKUP_CTE = """lookup AS (
  SELECT coordinate, field_name, field_label, field_type, model_name, model_id, field_id, line_no,
         is_foreign_key, target_model, is_fk_entry
  FROM (
    SELECT *, row_number() OVER (PARTITION BY coordinate ORDER BY is_fk_entry, prio) AS rn FROM (
      SELECT CAST(model_id AS VARCHAR) || '^' || CAST(field_id AS VARCHAR) AS coordinate,
             field_name, field_label, field_type, model_name, model_id, field_id, line_no,
             field_type = 'many2one' AS is_foreign_key,
             CASE WHEN field_type = 'many2one' THEN regexp_replace(primary_data_location, '\\.id$', '') END AS target_model,
             FALSE AS is_fk_entry, -line_no AS prio
      FROM catalog
      UNION ALL
      SELECT primary_model_id || '^' || primary_field_id, field_name, field_label, field_type, model_name,
             model_id, field_id, line_no, TRUE,
             regexp_replace(primary_data_location, '\\.id$', ''), TRUE, line_no
      FROM catalog
      WHERE field_type = 'many2one' AND primary_model_id <> '' AND primary_field_id <> ''
    ) u
  ) r WHERE rn = 1)"""


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM_PATTERN}', '', 'g')"


def js_rtrim(x: str) -> str:
    return f"regexp_replace({x}, '{JS_SPACE}+$', '')"


def number_text(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN '' WHEN abs({c}) < 1e15 AND {c} = trunc({c}) "
            f"THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END")


def encode_value(column: str | None, field_type: str, storage: str | None) -> str:
    if storage is None:
        return "'FALSE'" if field_type == "boolean" else "''"
    c = f'"{column}"'
    if field_type == "boolean":
        return f"CASE WHEN {c} IS NOT DISTINCT FROM TRUE THEN 'TRUE' ELSE 'FALSE' END" if storage == "boolean" else "'FALSE'"
    if field_type in ("many2many", "one2many"):
        if storage.startswith("array"):
            return f"CASE WHEN {c} IS NULL THEN '' ELSE '[' || array_to_string({c}, ',') || ']' END"
        return f"CASE WHEN {c} IS NULL THEN '' ELSE '[]' END"
    if storage == "double":
        return number_text(c)
    if field_type in ("char", "text", "html"):
        return f"coalesce(replace(CAST({c} AS VARCHAR), '|', '\\|'), '')"
    if storage.startswith("timestamp"):
        return (f"CASE WHEN {c} IS NULL THEN '' WHEN strftime({c}, '%f') = '000000' "
                f"THEN strftime({c}, '%Y-%m-%d %H:%M:%S') ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")
    if field_type == "binary":
        return f"CASE WHEN {c} IS NULL THEN '' ELSE '[binary]' END"
    return f"coalesce(CAST({c} AS VARCHAR), '')"


def record_source(model: str) -> tuple[str, dict[str, tuple[str, str]]]:
    """FROM clause of a model's records and field name -> (column, storage)."""
    cols = {}
    key = fx.KEY_COLUMNS.get(model)
    for name, storage in fx.TABLE_COLUMNS[model]:
        cols["id" if name == key else name] = (name, storage)
    src = model
    if model == "orders":
        src = ("(SELECT o.*, coalesce(lc.line_count, 0) AS line_count FROM orders o LEFT JOIN "
               "(SELECT l_orderkey, count(*) AS line_count FROM lineitem GROUP BY l_orderkey) lc "
               "ON o.o_orderkey = lc.l_orderkey)")
        cols["line_count"] = ("line_count", "bigint")
    return src, cols


def encode_select(model: str, exclude_models: tuple[str, ...] = (), where: str | None = None,
                  restricted: str | None = None) -> str:
    """SELECT producing (record_id, model_name, model_id, encoded_string, field_count)."""
    rows = [r for r in fx.catalog_rows() if r["model_name"] == model]
    src, cols = record_source(model)
    parts = []
    for r in rows:
        if r["field_type"] == "many2one":
            prefix = f"{r['primary_model_id']}^{r['primary_field_id']}"
        else:
            prefix = f"{r['model_id']}^{r['field_id']}"
        col, storage = cols.get(r["field_name"], (None, None))
        value = encode_value(col, r["field_type"], storage)
        if restricted:
            value = (f"coalesce((SELECT CASE WHEN reason = 'odoo_error' THEN 'Restricted_odoo_error' "
                     f"ELSE 'Restricted_from_API' END FROM {restricted} WHERE model_name = '{model}' "
                     f"AND field_name = '{r['field_name']}'), {value})")
        parts.append(f"'{prefix}*' || ({value})")
    key = cols.get("id", (None,))[0]
    rid = f'CAST("{key}" AS BIGINT)' if key else "CAST(NULL AS BIGINT)"
    w = f" WHERE {where}" if where else ""
    return (f"SELECT {rid} AS record_id, '{model}' AS model_name, {fx.MODEL_IDS[model]} AS model_id, "
            f"concat_ws('|', {', '.join(parts)}) AS encoded_string, {len(rows)} AS field_count FROM {src}{w}")


SEGMENTS_CTE = """segs AS (
  SELECT record_id, model_name, pos, {trim} AS seg FROM (
    SELECT record_id, model_name, generate_subscripts(parts, 1) - 1 AS pos,
           unnest(parts) AS seg0
    FROM (SELECT record_id, model_name,
                 string_split(replace(encoded_string, '\\|', chr(1)), '|') AS parts FROM enc) p
  ) x),
parsed AS (
  SELECT record_id, model_name, pos,
         CAST(TRY_CAST(regexp_extract(seg, '{re}', 1) AS BIGINT) AS VARCHAR) || '^' ||
         CAST(TRY_CAST(regexp_extract(seg, '{re}', 2) AS BIGINT) AS VARCHAR) AS coordinate,
         replace(regexp_extract(seg, '{re}', 3), '\\|', '|') AS raw_value
  FROM segs WHERE seg <> '' AND regexp_matches(seg, '{re}'))""".format(
    trim=js_trim("replace(seg0, chr(1), '\\|')"), re=SEGMENT_RE)


def display(raw: str = "raw_value", t: str = "field_type", target: str = "target_model", text_cut: int | None = 100) -> str:
    cut = raw if text_cut is None else f"CASE WHEN length({raw}) > {text_cut} THEN substr({raw}, 1, {text_cut}) || '...' ELSE {raw} END"
    num = f"TRY_CAST(regexp_extract({raw}, '{FLOAT_PREFIX}', 1) AS DOUBLE)"
    integer = f"TRY_CAST(regexp_extract({raw}, '{INT_PREFIX}', 1) AS BIGINT)"
    ts = f"TRY_CAST({raw} AS TIMESTAMP)"
    inner = f"regexp_extract({raw}, '^\\[(.+)\\]$', 1)"
    n_items = f"len(list_filter(string_split({inner}, ','), lambda x: {js_trim('x')} <> ''))"
    return f"""(CASE
  WHEN {raw} = 'Restricted_from_API' THEN '[API Restricted]'
  WHEN {raw} = 'Restricted_odoo_error' THEN '[Odoo Error]'
  WHEN {raw} IN ('', 'false', 'FALSE') THEN CASE WHEN {t} = 'boolean' AND {raw} IN ('false', 'FALSE') THEN 'No' ELSE '-' END
  WHEN {t} = 'monetary' THEN CASE WHEN {num} IS NULL THEN {raw} ELSE '$' || format('{{:,.0f}}', round({num}, 0)) END
  WHEN {t} = 'float' THEN CASE WHEN {num} IS NULL THEN {raw} ELSE format('{{:,.2f}}', round({num}, 2)) END
  WHEN {t} = 'integer' THEN CASE WHEN {integer} IS NULL THEN {raw} ELSE format('{{:,}}', {integer}) END
  WHEN {t} = 'boolean' THEN CASE WHEN {raw} IN ('TRUE', 'true') THEN 'Yes' ELSE 'No' END
  WHEN {t} = 'date' THEN coalesce(strftime({ts}, '%b %-d, %Y'), {raw})
  WHEN {t} = 'datetime' THEN coalesce(strftime({ts}, '%b %-d, %Y, %I:%M %p'), {raw})
  WHEN {t} = 'many2one' THEN '#' || {raw} || CASE WHEN coalesce({target}, '') <> '' THEN ' (' || {target} || ')' ELSE '' END
  WHEN {t} IN ('many2many', 'one2many') THEN CASE WHEN {raw} = '[]' THEN '-'
       WHEN regexp_matches({raw}, '^\\[(.+)\\]$') THEN '[' || CAST({n_items} AS VARCHAR) || ' items]' ELSE {raw} END
  WHEN {t} = 'selection' THEN {raw}
  WHEN {t} = 'binary' THEN CASE WHEN {raw} = '[binary]' THEN '[binary data]' ELSE {raw} END
  ELSE {cut}
END)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def key_fields_cte() -> str:
    rows = [(m, f) for m, fs in fx.KEY_FIELDS.items() for f in fs]
    values = ", ".join(f"({lit(m)}, {lit(f)})" for m, f in rows)
    return f"key_fields AS (SELECT * FROM (VALUES {values}) AS t(model_name, field_name))"


def decoded_select(key_filter: bool, text_cut: int | None = 100) -> str:
    kf = ("JOIN key_fields kf ON kf.model_name = p.model_name AND kf.field_name = l.field_name"
          if key_filter else "")
    return f"""SELECT p.record_id, p.model_name, CAST(p.pos AS INTEGER) AS pos, l.field_name, l.field_label, l.field_type,
  l.model_name AS field_model, p.raw_value,
  {display('p.raw_value', 'l.field_type', 'l.target_model', text_cut)} AS display_value,
  l.is_foreign_key, l.target_model
FROM parsed p JOIN lookup l ON p.coordinate = l.coordinate {kf}"""


def decoded_text_select(key_filter: bool, text_cut: int | None = 100) -> str:
    return f"""SELECT e.record_id, e.model_name, coalesce(d.txt, '{NO_FIELDS_TEXT}') AS decoded_text
FROM enc e LEFT JOIN (
  SELECT record_id, model_name,
         string_agg('- **' || field_label || ':** ' || display_value, chr(10) ORDER BY pos) AS txt
  FROM ({decoded_select(key_filter, text_cut)}) dd GROUP BY record_id, model_name) d
ON e.record_id IS NOT DISTINCT FROM d.record_id AND e.model_name = d.model_name"""


__all__ = ["catalog_cte", "catalog_line_cte", "EMAP_CTE", "LOOKUP_CTE", "SEGMENTS_CTE", "encode_select",
           "display", "with_ctes", "key_fields_cte", "decoded_select", "decoded_text_select", "js_trim",
           "JS_SPACE", "lit"]
