"""Column-level codec: value encoding by field type, pipe escaping, segment
parsing patterns and display formatting. Everything here returns a Spark
``Column`` (or Spark SQL text for wide encodes) made of built-in functions,
so it runs inside the JVM and whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (format of the encoded strings) ---------------------------
FIELD_SEP = "|"
VALUE_SEP = "*"
COORD_SEP = "^"
RESTRICTED_MARKER = "Restricted_from_API"       # field blocked by access rules
SOURCE_ERROR_MARKER = "Restricted_odoo_error"   # field the source failed to compute
RESTRICTED_DISPLAY = "[API Restricted]"
SOURCE_ERROR_DISPLAY = "[Odoo Error]"
NO_FIELDS_TEXT = "_No decodable fields found_"
BINARY_PLACEHOLDER = "[binary]"
BINARY_DISPLAY = "[binary data]"
TEXT_CUT = 100
RELATIONAL_TYPES = ("many2one", "one2many", "many2many")
# Split on a pipe that is not preceded by a backslash.
SPLIT_PATTERN = r"(?<!\\)\|"
# model id, field id, value; (?s) keeps multi-line values (deliberate fix).
SEGMENT_PATTERN = r"(?s)^(\d+)\^(\d+)\*(.*)$"
# White space removed by the source runtime's trim().
JS_SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# ---------------------------------------------------------------------------

TRIM_PATTERN = rf"^{JS_SPACE}+|{JS_SPACE}+$"
# The same white space set as literal characters (for btrim, no regex).
JS_SPACE_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000\ufeff")
INT_PREFIX = rf"^{JS_SPACE}*([+-]?\d+)"
FLOAT_PREFIX = rf"^{JS_SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def js_trim(c: Column) -> Column:
    """Trim the white space set of the source runtime (includes NBSP and BOM).

    A character-set trim (``btrim``), not a regex: linear and cheap on long values.
    """
    return F.btrim(c, F.lit(JS_SPACE_CHARS))


def js_rtrim(c: Column) -> Column:
    """Trailing white space removed (what decoding drops from a value, Q7)."""
    return F.regexp_replace(c, rf"{JS_SPACE}+$", "")


def js_parse_int(c: Column) -> Column:
    """Integer prefix of a text (``12abc`` -> 12), NULL if there is none."""
    return F.regexp_extract(c, INT_PREFIX, 1).try_cast("bigint")


def js_parse_float(c: Column) -> Column:
    """Float prefix of a text (``3.5x`` -> 3.5), NULL if there is none."""
    return F.regexp_extract(c, FLOAT_PREFIX, 1).try_cast("double")


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def unescape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("\\|"), F.lit("|"))


def strip_id_suffix(c: Column) -> Column:
    """Target model of a location ``model.id``: only a trailing ``.id`` is removed."""
    return F.regexp_replace(c, r"\.id$", "")


# --- encoding: Spark SQL text per field --------------------------------------

def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number_text_sql(c: str) -> str:
    """A double as the source runtime prints it: 450000 not 450000.0; an exponent
    (``1e-20``, ``1e+21``) only below 1e-6 and from 1e21 on."""
    plain = r"'\\.?0*$', ''"
    exponent = (f"regexp_replace(regexp_replace(cast({c} AS string), "
                r"'\\.0E|E', 'e'), 'e([0-9])', 'e+$1')")
    return (
        f"CASE WHEN {c} IS NULL THEN '' "
        f"WHEN isnan({c}) THEN 'NaN' "
        f"WHEN {c} = double('Infinity') THEN 'Infinity' "
        f"WHEN {c} = double('-Infinity') THEN '-Infinity' "
        f"WHEN abs({c}) < 1e15D AND ({c} % 1.0D) = 0 THEN cast(cast({c} AS bigint) AS string) "
        f"WHEN abs({c}) >= 1e21D OR abs({c}) < 1e-6D THEN {exponent} "
        f"WHEN ({c} % 1.0D) = 0 THEN cast(try_cast({c} AS decimal(38,0)) AS string) "
        f"WHEN abs({c}) < 1e6D THEN regexp_replace(cast(try_cast({c} AS decimal(38,30)) AS string), {plain}) "
        f"ELSE regexp_replace(cast(try_cast({c} AS decimal(38,18)) AS string), {plain}) END"
    )


def encode_value_sql(column: str | None, field_type: str, dtype: T.DataType | None) -> str:
    """Spark SQL text for the encoded value of one field.

    ``dtype`` None means the record has no such column: the value is absent.
    """
    if dtype is None:
        return "'FALSE'" if field_type == "boolean" else "''"
    c = _q(column)
    if field_type == "boolean":
        if isinstance(dtype, T.BooleanType):
            return f"CASE WHEN {c} <=> true THEN 'TRUE' ELSE 'FALSE' END"
        return "'FALSE'"
    if field_type == "many2one":
        if isinstance(dtype, T.StructType):
            inner = f"{c}.{_q(dtype.fields[0].name)}"
            return f"coalesce(cast({inner} AS string), '')"
        if isinstance(dtype, (T.IntegralType, T.DecimalType)):
            return f"coalesce(cast({c} AS string), '')"
        return "''"
    if field_type in ("many2many", "one2many"):
        if isinstance(dtype, T.ArrayType):
            return (f"CASE WHEN {c} IS NULL THEN '' ELSE "
                    f"concat('[', array_join(cast({c} AS array<string>), ',', ''), ']') END")
        return f"CASE WHEN {c} IS NULL THEN '' ELSE '[]' END"
    if field_type in ("integer", "float", "monetary"):
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return number_text_sql(f"cast({c} AS double)")
        if isinstance(dtype, T.DecimalType):
            return (r"coalesce(regexp_replace(regexp_replace(cast(" + c +
                    r" AS string), '(\\.[0-9]*?)0+$', '$1'), '\\.$', ''), '')")
        return f"coalesce(cast({c} AS string), '')"
    if field_type in ("char", "text", "html"):
        return r"coalesce(replace(cast(" + c + r" AS string), '|', '\\|'), '')"
    if field_type in ("date", "datetime"):
        if isinstance(dtype, T.DateType):
            return f"coalesce(date_format({c}, 'yyyy-MM-dd'), '')"
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return (f"CASE WHEN {c} IS NULL THEN '' "
                    f"WHEN date_format({c}, 'SSSSSS') = '000000' THEN date_format({c}, 'yyyy-MM-dd HH:mm:ss') "
                    f"ELSE date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END")
        return f"coalesce(cast({c} AS string), '')"
    if field_type == "binary":
        if isinstance(dtype, T.StringType):
            return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '' ELSE '[binary]' END"
        if isinstance(dtype, T.BinaryType):
            return f"CASE WHEN {c} IS NULL OR length({c}) = 0 THEN '' ELSE '[binary]' END"
        return f"CASE WHEN {c} IS NULL THEN '' ELSE '[binary]' END"
    # selection and any other type: the text of the value
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text_sql(f"cast({c} AS double)")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"coalesce(to_json({c}), '')"
    return f"coalesce(cast({c} AS string), '')"


# --- decoding / display ----------------------------------------------------------

def display_helpers(raw: Column, field_type: Column | None = None) -> dict[str, Column]:
    """Parsed forms of a raw value used by ``display_value`` (number, integer, time).

    With ``field_type`` each parse runs only for the types that show it, so
    text values never go through the number regexes.
    """
    num, integer, ts = js_parse_float(raw), js_parse_int(raw), raw.try_cast("timestamp_ntz")
    if field_type is None:
        return {"_num": num, "_int": integer, "_ts": ts}
    return {
        "_num": F.when(field_type.isin("monetary", "float"), num),
        "_int": F.when(field_type == "integer", integer),
        "_ts": F.when(field_type.isin("date", "datetime"), ts),
    }


def with_display(df, raw: str, field_type: str, target_model: str, out: str = "display_value"):
    """Add ``out`` = E8 display text; helpers are projected first and dropped after,
    which keeps each generated method small."""
    h = display_helpers(F.col(raw), F.col(field_type))
    df = df.select("*", *[c.alias(k) for k, c in h.items()])
    df = df.withColumn(out, display_value(F.col(raw), F.col(field_type), F.col(target_model),
                                          {k: F.col(k) for k in h}))
    return df.drop(*h)


def display_value(raw: Column, field_type: Column, target_model: Column,
                  helpers: dict[str, Column] | None = None, text_cut: int | None = TEXT_CUT) -> Column:
    """Human-readable text of a raw value by field type; long texts are cut at
    ``text_cut`` characters (None: not cut).

    Rounding is half away from zero (``round`` before ``format_number``);
    dates are read and shown in UTC wall time.
    """
    h = helpers or display_helpers(raw)
    shown = _shown_marks(raw).when(raw.isin("", "false", "FALSE"),
                                   F.when((field_type == "boolean") & raw.isin("false", "FALSE"), F.lit("No")).otherwise(F.lit("-")))
    for kinds, branch in _SHOWN.items():
        shown = shown.when(field_type.isin(*kinds), branch(raw, target_model, h))
    return shown.otherwise(_shown_text(raw, text_cut))


def display_known(raw: Column, field_type: str, target_model: str | None, text_cut: int | None = TEXT_CUT) -> Column:
    """``display_value`` of a field whose type and target are known when the plan is built."""
    branch = next((b for kinds, b in _SHOWN.items() if field_type in kinds), None)
    shown = _shown_marks(raw).when(raw == "", F.lit("-")).when(
        raw.isin("false", "FALSE"), F.lit("No" if field_type == "boolean" else "-"))
    value = branch(raw, F.lit(target_model or ""), display_helpers(raw)) if branch else _shown_text(raw, text_cut)
    return shown.otherwise(value)


def _shown_marks(raw: Column) -> Column:
    return (F.when(raw == F.lit(RESTRICTED_MARKER), F.lit(RESTRICTED_DISPLAY))
            .when(raw == F.lit(SOURCE_ERROR_MARKER), F.lit(SOURCE_ERROR_DISPLAY)))


def _shown_text(raw: Column, text_cut: int | None) -> Column:
    if text_cut is None:
        return raw
    return F.when(F.length(raw) > text_cut, F.concat(F.substring(raw, 1, text_cut), F.lit("..."))).otherwise(raw)


def _shown_list(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"^\[(.+)\]$", 1)
    n_items = F.size(F.filter(F.split(inner, ",", -1), lambda x: js_trim(x) != F.lit("")))
    return (F.when(raw == "[]", F.lit("-"))
            .when(raw.rlike(r"^\[(.+)\]$"), F.concat(F.lit("["), n_items.cast("string"), F.lit(" items]")))
            .otherwise(raw))


#: Field types and what shows a value of theirs, from (raw value, target model, parsed forms).
_SHOWN = {
    ("monetary",): lambda raw, target, h: F.when(h["_num"].isNull(), raw).otherwise(
        F.concat(F.lit("$"), F.format_number(F.round(h["_num"], 0), 0))),
    ("float",): lambda raw, target, h: F.when(h["_num"].isNull(), raw).otherwise(F.format_number(F.round(h["_num"], 2), 2)),
    ("integer",): lambda raw, target, h: F.when(h["_int"].isNull(), raw).otherwise(F.format_number(h["_int"], 0)),
    ("boolean",): lambda raw, target, h: F.when(raw.isin("TRUE", "true"), F.lit("Yes")).otherwise(F.lit("No")),
    ("date",): lambda raw, target, h: F.coalesce(F.date_format(h["_ts"], "MMM d, yyyy"), raw),
    ("datetime",): lambda raw, target, h: F.coalesce(F.date_format(h["_ts"], "MMM d, yyyy, hh:mm a"), raw),
    ("many2one",): lambda raw, target, h: F.concat(F.lit("#"), raw, F.when(
        F.coalesce(target, F.lit("")) != "", F.concat(F.lit(" ("), target, F.lit(")"))).otherwise(F.lit(""))),
    ("many2many", "one2many"): lambda raw, target, h: _shown_list(raw),
    ("selection",): lambda raw, target, h: raw,
    ("binary",): lambda raw, target, h: F.when(raw == BINARY_PLACEHOLDER, F.lit(BINARY_DISPLAY)).otherwise(raw),
}
