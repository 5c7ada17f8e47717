"""Text-valued column functions: semantic text of a catalog field (E11),
checksums (E12), text cut and token estimate (E14), hit report columns
(E15), error-log classification (E16) and query text keys (E17).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import strip_id_suffix

# --- fixed values ----------------------------------------------------------------
EMBED_MAX_CHARS = 30_000          # text cut before embedding
CHARS_PER_TOKEN = 4               # token estimate: ceil(length / 4)
# Error-log patterns (case-insensitive), in the order they are tried.
SECURITY_RE = r"(?i)security restrictions"
DOC_MODEL_RE = r"(?i)Document type:\s*[^(]*\(([^)]+)\)"
OPERATION_RE = r"(?i)Operation:\s*(\w+)"
FIELDS_SECTION_RE = r"(?is)Fields:\s*(.*?)(?:\n\n|$)"
FIELD_ITEM_RE = r"-\s+(\w+)(?:\s*\(|$|\n)"
FIELD_ALT_RE = r"(?i)Field\s+['\"]?(\w+)['\"]?\s+(?:cannot|can not)"
COMPUTE_RE = r"(?i)Compute method failed to assign\s+([^(]+)\([^)]*\)\.(\w+)"
COMPUTE_ALT_RE = r"(?i)field\s+['\"]?(\w+)['\"]?\s+(?:cannot|can not)\s+be\s+computed"
ACCESS_RE = r"(?i)access denied"
ACCESS_MODEL_RE = r"(?i)model\s+['\"]?([^'\"]+)['\"]?"
ACCESS_FIELDS_RE = r"(?i)fields?:\s*\[?([^\]]+)\]?"
SINGLETON_RE = r"(?i)Expected singleton:\s*([a-z_]+(?:\.[a-z_]+)*)\s*\("
RESTRICTION_HINTS = (r"(?i)security restrictions", r"(?i)Compute method failed", r"(?i)cannot be computed",
                     r"(?i)access denied", r"(?i)permission denied", r"(?i)not have.*permission",
                     r"(?i)allowed for groups", r"(?i)Expected singleton")
# ----------------------------------------------------------------------------------


def semantic_text(c=F.col) -> Column:
    """The fixed sentence embedded for a catalog field. Absent parts are NULL
    and vanish in ``concat_ws``."""
    model, mid, name, fid = c("model_name"), c("model_id").cast("string"), c("field_name"), c("field_id").cast("string")
    label, ftype, loc = c("field_label"), c("field_type"), c("primary_data_location")
    pm, pf = c("primary_model_id"), c("primary_field_id")
    related = strip_id_suffix(loc)
    return F.concat_ws(
        " ",
        F.concat(F.lit("FIELD IN "), model, F.lit(" (model_id "), mid, F.lit("):")),
        F.concat(name, F.lit(" (field_id "), fid, F.lit(")")),
        F.concat(F.lit("- model coordinate 4^58*"), mid),
        F.concat(F.lit("- field coordinate 4^58*"), fid),
        F.concat(F.lit("column attribute property of "), model),
        F.when((F.coalesce(label, F.lit("")) != "") & (label != name),
               F.concat(F.lit('labeled "'), label, F.lit('"'))),
        F.concat(F.lit("- "), ftype, F.lit(" type")),
        F.when(ftype == "many2one", F.concat(F.lit("- REFERENCES "), related))
        .when(ftype == "one2many", F.lit("- one2many related records in other model"))
        .when(ftype == "many2many", F.lit("- many2many related records")),
        F.when(ftype == "many2one", F.concat(F.lit("- foreign key linking to "), related)),
        F.when(c("stored"), F.lit("- stored in database")).otherwise(F.lit("- computed field not stored")),
        F.when((F.coalesce(loc, F.lit("")) != "") & (loc != "Computed"), F.concat(F.lit("- data at "), loc)),
        F.when((F.coalesce(pm, F.lit("")) != "") & (F.coalesce(pf, F.lit("")) != ""),
               F.concat(F.lit("- primary ref "), pm, F.lit("^"), pf)),
    )


def checksum(text: Column) -> Column:
    """MD5 hex of the UTF-8 text."""
    return F.md5(text)


def embed_input(text: Column, max_chars: int | None = None) -> Column:
    """Text as sent to the embedder: whole, or its first ``max_chars``
    characters (``EMBED_MAX_CHARS`` for an embedder with the usual limit)."""
    return text if max_chars is None else F.substring(text, 1, max_chars)


def token_estimate(text: Column) -> Column:
    """ceil(length / 4)."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def score_percent(score: Column) -> Column:
    """Score as percent with one decimal (half away from zero)."""
    return F.concat(F.format_number(F.round(score * 100, 1), 1), F.lit("%"))


def _uniq(arr: Column) -> Column:
    return F.array_distinct(F.filter(arr, lambda x: x != F.lit("")))


def classify_error(message: Column) -> dict[str, Column]:
    """Error type, model, operation and field list of a source error text.

    Returns the columns so callers can project them in one ``select``.
    Types: security_restriction, compute_error, singleton_error, unknown.
    """
    msg = F.replace(message, F.lit("\\n"), F.lit("\n"))
    is_sec = msg.rlike(SECURITY_RE)
    sec_section = F.regexp_extract(msg, FIELDS_SECTION_RE, 1)
    sec_fields = _uniq(F.regexp_extract_all(sec_section, F.lit(FIELD_ITEM_RE), 1))
    sec_alt = _uniq(F.regexp_extract_all(msg, F.lit(FIELD_ALT_RE), 1))
    sec_fields = F.when(F.size(sec_fields) > 0, sec_fields).otherwise(sec_alt)
    comp = msg.rlike(COMPUTE_RE)
    comp_alt = _uniq(F.regexp_extract_all(msg, F.lit(COMPUTE_ALT_RE), 1))
    access = msg.rlike(ACCESS_RE)
    access_lists = F.regexp_extract_all(msg, F.lit(ACCESS_FIELDS_RE), 1)
    access_fields = _uniq(F.flatten(F.transform(
        access_lists, lambda s: F.filter(F.split(s, r"[,\s]+", -1), lambda f: f.rlike(r"^\w+$")))))
    singleton = msg.rlike(SINGLETON_RE)
    err_type = (F.when(is_sec, F.lit("security_restriction"))
                .when(comp, F.lit("compute_error"))
                .when(access, F.lit("security_restriction"))
                .when(singleton, F.lit("singleton_error"))
                .when(F.size(comp_alt) > 0, F.lit("compute_error"))
                .otherwise(F.lit("unknown")))
    model = (F.when(is_sec, F.nullif(F.trim(F.regexp_extract(msg, DOC_MODEL_RE, 1)), F.lit("")))
             .when(comp, F.trim(F.regexp_extract(msg, COMPUTE_RE, 1)))
             .when(access, F.nullif(F.trim(F.regexp_extract(msg, ACCESS_MODEL_RE, 1)), F.lit("")))
             .when(singleton, F.trim(F.regexp_extract(msg, SINGLETON_RE, 1))))
    operation = F.when(is_sec, F.nullif(F.lower(F.regexp_extract(msg, OPERATION_RE, 1)), F.lit("")))
    fields = (F.when(is_sec, sec_fields)
              .when(comp, F.array(F.regexp_extract(msg, COMPUTE_RE, 2)))
              .when(access, _uniq(F.concat(comp_alt, access_fields)))
              .otherwise(comp_alt))
    hint = None
    for p in RESTRICTION_HINTS:
        hint = message.rlike(p) if hint is None else hint | message.rlike(p)
    return {"error_type": err_type, "model": model, "operation": operation,
            "restricted_fields": fields, "is_restriction": hint,
            "is_singleton": message.rlike(r"(?i)Expected singleton")}


def query_key(query: Column, mode: Column, model_name: Column, field_types: Column,
              limit: Column, min_similarity: Column, point_type: Column) -> Column:
    """Canonical key of a search request (lower-cased trimmed text + parameters)."""
    return F.to_json(F.struct(
        F.trim(F.lower(query)).alias("query"), mode.alias("mode"), model_name.alias("modelName"),
        F.array_sort(field_types).alias("fieldTypes"), limit.alias("limit"),
        min_similarity.alias("minSimilarity"), point_type.alias("pointType")))
