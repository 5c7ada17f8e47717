"""Record codec over tables: encode records to coordinate strings (E1) and
decode them back (E6, E7, E9, A13) with the coordinate lookup (J1) and
key-field restriction (J2).

Encoding is a single projection (no shuffle). Row-level decoding is an
explode plus a broadcast hash join on the schema-sized lookup. Per-record
decoded text and decode statistics stay in the record's row: its segments are
matched by place with the fields of its model, and only those that aren't
where the encoder puts them are looked up, by hash.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.codec import (
    JS_SPACE_CHARS, NO_FIELDS_TEXT, RESTRICTED_MARKER, SEGMENT_PATTERN, SOURCE_ERROR_MARKER, SPLIT_PATTERN,
    TEXT_CUT, display_known, display_value, encode_value_sql, js_trim, unescape_pipe, with_display,
)
from .common import checked_broadcast, collect_bounded
from .ops import SOURCE_REASON

#: Upper bound of fields of one model we build an encode expression for.
MAX_FIELDS_PER_MODEL = 20_000
#: Upper bound of lookup entries we ship to every task.
MAX_LOOKUP_ENTRIES = 2_000_000


def encoding_plan(emap: DataFrame) -> dict[str, list]:
    """The encoding map collected once for all models (schema-sized, bounded):
    model -> field rows in catalog order. Lets many encodes share one job."""
    rows = collect_bounded(emap.select("model_name", "field_name", "prefix", "field_type", "model_id", "line_no"),
                           MAX_LOOKUP_ENTRIES, "encoding map")
    plan: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        plan.setdefault(r["model_name"], []).append(r)
    return plan


def encode_records(records: DataFrame, emap: DataFrame | dict, model_name: str,
                   restrictions: dict[str, str] | None = None,
                   model_id: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One coordinate string per record, fields in catalog order.

    ``emap`` is the encoding map (``catalog.encoding_map``); only the rows of
    ``model_name`` are used. ``restrictions`` maps field name -> reason for
    fields the source refused (P9/E5): they are not read and carry a marker.
    The encode is one Spark SQL expression, so wide models stay cheap to plan.
    ``keep`` carries extra record columns through (no re-join later).
    """
    restrictions = restrictions or {}
    if isinstance(emap, dict):
        rows = emap.get(model_name, [])
    else:
        rows = collect_bounded(
            emap.filter(F.col("model_name") == model_name)
            .select("field_name", "prefix", "field_type", "model_id", "line_no").orderBy("line_no"),
            MAX_FIELDS_PER_MODEL, "fields of model " + model_name)
    if not rows:
        raise ValueError(f"no catalog rows for model {model_name!r}")
    if model_id is None:
        model_id = rows[0]["model_id"]
    readable = records.drop(*[f for f in restrictions if f in records.columns])
    types = {f.name: f.dataType for f in readable.schema.fields}
    parts = []
    for r in rows:
        name = r["field_name"]
        if name in restrictions:
            marker = SOURCE_ERROR_MARKER if restrictions[name] == SOURCE_REASON else RESTRICTED_MARKER
            value = f"'{marker}'"
        else:
            value = encode_value_sql(name, r["field_type"], types.get(name))
        prefix = r["prefix"].replace("\\", "\\\\").replace("'", "\\'")  # catalog text, not SQL
        parts.append(f"concat('{prefix}*', {value})")
    expr = "concat_ws('|', " + ", ".join(parts) + ")"
    record_id = F.col("id").cast("long") if "id" in readable.columns else F.lit(None).cast("long")
    return readable.select(
        record_id.alias("record_id"),
        F.lit(model_name).alias("model_name"),
        F.lit(int(model_id)).alias("model_id"),
        F.expr(expr).alias("encoded_string"),
        F.lit(len(rows)).alias("field_count"),
        *[F.col(k) for k in keep],
    )


def _head(seg: Column) -> Column:
    """``model^field`` part of a segment already known to match SEGMENT_PATTERN."""
    return F.substring_index(seg, "*", 1)


def _value(seg: Column) -> Column:
    """Value part (after the first ``*``) of a matching segment, unescaped."""
    return unescape_pipe(F.substring(seg, F.instr(seg, "*") + 1, F.lit(1 << 30)))


def _coordinate(seg: Column) -> Column:
    """Normalised ``model^field`` (numbers as integers, like parseInt) of a matching segment."""
    head = _head(seg)
    mid = F.substring_index(head, "^", 1).try_cast("bigint")
    fid = F.substring_index(head, "^", -1).try_cast("bigint")
    return F.concat_ws("^", mid.cast("string"), fid.cast("string"))


def parse_encoded(encoded: DataFrame, keep: tuple[str, ...] = ("record_id", "model_name")) -> DataFrame:
    """One row per well-formed segment ``(pos, coordinate, model_id, field_id, raw_value)``.

    ``pos`` is the segment's position in the string, so order survives.
    Malformed segments are left out (see ``malformed_segments``).
    """
    seg = F.col("seg")
    ex = encoded.select(*keep, F.posexplode(F.split(F.col("encoded_string"), SPLIT_PATTERN, -1)).alias("pos", "seg"))
    ex = ex.withColumn("seg", js_trim(seg)).filter(seg != "")
    ok = ex.filter(seg.rlike(SEGMENT_PATTERN))
    return ok.select(
        *keep, "pos", _coordinate(seg).alias("coordinate"),
        F.substring_index(_head(seg), "^", 1).try_cast("bigint").alias("seg_model_id"),
        F.substring_index(_head(seg), "^", -1).try_cast("bigint").alias("seg_field_id"),
        _value(seg).alias("raw_value"),
    )


def malformed_segments(encoded: DataFrame, keep: tuple[str, ...] = ("record_id", "model_name")) -> DataFrame:
    """S3 for decoding: segments that do not match ``model^field*value``."""
    seg = F.col("seg")
    ex = encoded.select(*keep, F.posexplode(F.split(F.col("encoded_string"), SPLIT_PATTERN, -1)).alias("pos", "seg"))
    ex = ex.withColumn("seg", js_trim(seg))
    return ex.filter((seg != "") & ~seg.rlike(SEGMENT_PATTERN))


def segment_fault(seg: Column) -> Column:
    """Why a segment isn't ``model^field*value`` (NULL if it is)."""
    head = F.substring_index(seg, "*", 1)
    return F.when(~seg.rlike(SEGMENT_PATTERN), F.when(F.instr(seg, "*") == 0, F.lit("no value separator"))
                  .when(F.instr(head, "^") == 0, F.lit("no coordinate separator"))
                  .when(~F.substring_index(head, "^", 1).rlike(r"^\d+$"), F.lit("model id is not a number"))
                  .otherwise(F.lit("field id is not a number")))


def quarantine_segments(encoded: DataFrame, path: str,
                        keep: tuple[str, ...] = ("record_id", "model_name")) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """S3 for decoding: one scan of the encoded strings, two outputs. Returns the well-formed
    segments, the malformed ones with position and reason, and the counts of both
    (taken while they are written). Nothing is dropped but empty segments."""
    ex = encoded.select(*keep, F.posexplode(F.split(F.col("encoded_string"), SPLIT_PATTERN, -1)).alias("pos", "seg"))
    ex = ex.withColumn("seg", js_trim(F.col("seg"))).filter(F.col("seg") != "")
    ex = ex.withColumn("reason", segment_fault(F.col("seg"))).withColumn("malformed", F.col("reason").isNotNull())
    seen = Observation()
    ex.observe(seen, F.count_if(~F.col("malformed")).alias("good"), F.count_if("malformed").alias("malformed")) \
        .write.partitionBy("malformed").parquet(path)
    back = encoded.sparkSession.read.schema(ex.schema).parquet(path)
    good = back.filter(~F.col("malformed")).drop("malformed", "reason")
    return good, back.filter("malformed").drop("malformed"), seen.get


def _key_field_filter(decoded: DataFrame, key_fields: DataFrame | None) -> DataFrame:
    if key_fields is None:
        return decoded
    kf = checked_broadcast(key_fields.select("model_name", "field_name").distinct(), 1_000_000)
    return decoded.join(kf, ["model_name", "field_name"], "left_semi")


def decode_records(encoded: DataFrame, lookup: DataFrame, key_fields: DataFrame | None = None,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Decoded fields in segment order, one row per known coordinate.

    Unknown coordinates are skipped (J1, inner broadcast join on the
    schema-sized lookup). With ``key_fields`` (model_name, field_name) only
    those fields of each record's model are kept (J2); none = all.
    """
    meta = lookup.select(
        "coordinate", "field_name", "field_label", "field_type",
        F.col("model_name").alias("field_model"), "is_foreign_key", "target_model")
    segs = parse_encoded(encoded, ("record_id", "model_name", *carry))
    joined = segs.join(checked_broadcast(meta, MAX_LOOKUP_ENTRIES), "coordinate", "inner")
    joined = _key_field_filter(joined, key_fields)
    joined = with_display(joined, "raw_value", "field_type", "target_model")
    return joined.select(
        "record_id", "model_name", "pos", "field_name", "field_label", "field_type", "field_model",
        "raw_value", "display_value", "is_foreign_key", "target_model", *carry,
    )


#: What a decoded segment shows of its catalog field.
_ENTRY = ("field_name", "field_label", "field_type", "target_model")
_ENTRY_TYPE = "struct<" + ",".join(f"{c}:string" for c in _ENTRY) + ">"


class DecodeTables:
    """What decoding within the row needs of the catalog (schema-sized, bounded, collected once).

    * ``fields``: per model, in encoding order, ``(head, entry)``: head is the
      text that the segment at that place starts with, entry None if the lookup
      doesn't know the coordinate. The order is that of ``emap``
      (``catalog.encoding_map`` or an ``encoding_plan``); without it, the
      lookup's own fields in catalog order.
    * ``entries``: the lookup, coordinate -> field name, label, type, target.
    """

    def __init__(self, lookup: DataFrame, emap: DataFrame | dict | None = None) -> None:
        self.spark = lookup.sparkSession
        rows = collect_bounded(lookup.select("coordinate", "model_name", "line_no", *_ENTRY), MAX_LOOKUP_ENTRIES, "coordinate lookup")
        self.entries = {r["coordinate"]: tuple(r[c] for c in _ENTRY) for r in rows}
        plan: dict[str, list] = {}
        if emap is None:
            for r in sorted(rows, key=lambda r: (r["line_no"], r["coordinate"])):
                plan.setdefault(r["model_name"], []).append(r["coordinate"])
        else:
            own = emap if isinstance(emap, dict) else encoding_plan(emap)
            plan = {model: [r["prefix"] for r in fields] for model, fields in own.items()}
        self.fields = {model: [self._field(p) for p in prefixes] for model, prefixes in plan.items()}

    def _field(self, prefix: str | None) -> tuple | None:
        m = re.fullmatch(r"([0-9]+)\^([0-9]+)", prefix or "")
        return (prefix + "*", self.entries.get(f"{int(m[1])}^{int(m[2])}")) if m else None

    def layout(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.fields.items()), f"model_name string, _fields array<struct<head:string,entry:{_ENTRY_TYPE}>>")

    def hash_table(self) -> tuple[Column, int]:
        """The lookup as an array of hash buckets, and their number: a segment that is not where its model's
        fields have it is found by hash, not by a search through the catalog."""
        size = max(1, len(self.entries))
        table: list[list] = [[] for _ in range(size)]
        for coordinate, entry in self.entries.items():
            table[zlib.crc32(coordinate.encode()) % size].append((coordinate, entry))
        one = self.spark.createDataFrame([(table,)], f"t array<array<struct<coordinate:string,entry:{_ENTRY_TYPE}>>>")
        return one.scalar(), size


def _parts() -> Column:
    return F.coalesce(F.split(F.col("encoded_string"), SPLIT_PATTERN, -1), F.array().cast("array<string>"))


def _own_value(seg: Column, head: Column | str) -> Column:
    """Value of a segment that starts with ``head``: its trailing white space goes (Q7), its lead stays."""
    start = F.length(head) + 1 if isinstance(head, Column) else F.lit(len(head) + 1)
    return unescape_pipe(F.rtrim(F.substring(seg, start, F.lit(1 << 30)), F.lit(JS_SPACE_CHARS)))


def resolve_segments(encoded: DataFrame, tables: DecodeTables, parts: Column | None = None, values: bool = True,
                     placed: bool = True) -> DataFrame:
    """J1 within the row: adds ``segments``, an array over the well-formed segments in order, each
    ``(raw_value, entry)``; entry is NULL for an unknown coordinate.

    A record is split in place. Where segment i starts with the head of field i
    of its model (every segment that the encoder wrote), the entry is that
    field's; only a foreign or shifted segment is matched by pattern and found
    in the lookup by hash, and a malformed one is left out. Nothing is
    exploded, so no record is shuffled or regrouped. Without ``values`` the raw
    values are left NULL; with ``placed`` false every segment is found by hash.
    """
    table, size = tables.hash_table()
    df = encoded.withColumn("_table", table)
    if placed:  # at most MAX_LOOKUP_ENTRIES catalog rows: bounded when they were collected
        df = df.join(F.broadcast(tables.layout()), "model_name", "left")

    def pair(value: Column, entry: Column) -> Column:
        return F.struct((value if values else F.lit(None).cast("string")).alias("raw_value"), entry.alias("entry"))

    def by_hash(seg: Column) -> Column:
        seg = js_trim(seg)
        coordinate = _coordinate(seg)
        bucket = F.get(F.col("_table"), (F.crc32(coordinate.cast("binary")) % size).cast("int"))
        found = F.get(F.filter(bucket, lambda e: e["coordinate"] == coordinate), F.lit(0))
        return F.when(seg.rlike(SEGMENT_PATTERN), pair(_value(seg), found["entry"]))

    def by_place(seg: Column, i: Column) -> Column:
        field = F.get(F.col("_fields"), i)
        here = F.coalesce(F.startswith(seg, field["head"]), F.lit(False))
        return F.when(here, pair(_own_value(seg, field["head"]), field["entry"])).otherwise(by_hash(seg))

    found = F.transform(_parts() if parts is None else parts, by_place if placed else by_hash)
    segments = F.filter(found, lambda x: x.isNotNull())
    return df.select(*encoded.columns, segments.alias("segments"))


def decode_text(encoded: DataFrame, lookup: DataFrame | DecodeTables, key_fields: dict[str, list[str]] | None = None,
                keep_all: bool = False, emap: DataFrame | dict | None = None, text_cut: int | None = TEXT_CUT,
                model: str | None = None) -> DataFrame:
    """Per record the lines ``- **label:** value`` in segment order, joined by newlines.

    A projection: no shuffle. Records with nothing decodable get the fixed
    fallback text. With ``keep_all`` the other input columns are kept. ``emap``
    as in ``DecodeTables`` (which can stand for lookup and emap); long texts are cut at ``text_cut`` characters
    (None: not cut). Where all records are of one ``model``, its fields are
    written out in the plan (compiled, each with the display of its own type)
    and only records that aren't as the encoder writes them go segment by segment.
    """
    carry = tuple(c for c in encoded.columns if c not in ("record_id", "model_name")) if keep_all else ()
    tables = lookup if isinstance(lookup, DecodeTables) else DecodeTables(lookup, emap)

    def shown(x: Column) -> Column:
        known = x["entry"].isNotNull()
        if key_fields:
            allowed = ~F.col("model_name").isin(*key_fields)
            for m, fs in key_fields.items():
                allowed = allowed | ((F.col("model_name") == m) & x["entry"]["field_name"].isin(*fs))
            known = known & F.coalesce(allowed, F.lit(False))
        return known

    def line(x: Column) -> Column:
        e = x["entry"]
        value = display_value(x["raw_value"], e["field_type"], e["target_model"], text_cut=text_cut)
        return F.concat(F.lit("- **"), e["field_label"], F.lit(":** "), value)

    fields = tables.fields.get(model) if model else None
    if not fields or any(f is None for f in fields):
        df = resolve_segments(encoded, tables)
        text = F.array_join(F.transform(F.filter("segments", shown), line), "\n")
    else:
        df = encoded.withColumn("_parts", _parts())
        regular = F.size("_parts") == len(fields)
        lines = []
        for i, (head, entry) in enumerate(fields):
            seg = F.get("_parts", F.lit(i))
            regular = regular & F.startswith(seg, F.lit(head))
            if entry and (not key_fields or model not in key_fields or entry[0] in key_fields[model]):
                df = df.withColumn(f"_v{i}", _own_value(seg, head))
                lines.append(F.concat(F.lit(f"- **{entry[1]}:** "), display_known(F.col(f"_v{i}"), entry[2], entry[3], text_cut)))
        regular = F.coalesce(regular & (F.col("model_name") == model), F.lit(False))
        df = df.withColumn("_regular", regular)
        # the others' parts only: a record that is as the encoder writes it has no segment to resolve
        df = resolve_segments(df, tables, F.when(~F.col("_regular"), F.col("_parts")), placed=False)
        other = F.array_join(F.transform(F.filter("segments", shown), line), "\n")
        text = F.when(F.col("_regular"), F.concat_ws("\n", *lines)).otherwise(other)
    # explode of one value: what filters on the text then reads it, instead of decoding again
    df = df.select("record_id", "model_name", *carry, F.explode(F.array(text)).alias("_text"))
    return df.select("record_id", "model_name", *carry,
                     F.when(F.col("_text") == "", F.lit(NO_FIELDS_TEXT)).otherwise(F.col("_text")).alias("decoded_text"))


def decode_stats(encoded: DataFrame, lookup: DataFrame, emap: DataFrame | dict | None = None) -> DataFrame:
    """Per record the number of segments, decoded and unknown ones, and a
    ``type:count`` list (sorted by type) of the decoded field types. No shuffle."""
    df = resolve_segments(encoded.select("record_id", "model_name", "encoded_string"), DecodeTables(lookup, emap), values=False)
    types = F.transform("segments", lambda x: x["entry"]["field_type"])
    df = df.select("record_id", "model_name", types.alias("types"))
    df = df.select("record_id", "model_name", F.size("types").alias("total_segments"), F.array_sort(F.array_compact("types")).alias("types"))
    types = F.col("types")
    per_type = F.transform(F.array_distinct(types), lambda t: F.concat(
        t, F.lit(":"), F.size(F.filter(types, lambda u: u == t)).cast("string")))
    return df.select("record_id", "model_name", "total_segments", F.size(types).alias("decoded_fields"),
                     (F.col("total_segments") - F.size(types)).alias("unknown_coordinates"),
                     F.array_join(per_type, ",").alias("field_types"))
