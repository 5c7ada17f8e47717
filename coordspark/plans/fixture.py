"""Field catalog over the driver's test tables, and the record view of each table.

The reference keeps an exported ERP field catalog; the test tables have none,
so we derive one from their column lists by the rules below. Every operator
reads the catalog as a DataFrame, never as this Python structure; the
structure only seeds the catalog text (one encoded line per field) that
``sources.catalog_text.parse_catalog`` turns into the catalog table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# --- fixed values -----------------------------------------------------------
# Column lists of the driver tables (name, storage type), in file order.
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
}

# Model ids in catalog order (region 1 ... conversations 14).
MODEL_IDS: dict[str, int] = {name: i + 1 for i, name in enumerate(TABLE_COLUMNS)}

# Single-column key of each table; renamed ``id`` in the record view.
KEY_COLUMNS: dict[str, str] = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id",
}

# many2one columns: (model, column) -> target model.
FK_TARGETS: dict[tuple[str, str], str] = {
    ("nation", "n_regionkey"): "region", ("customer", "c_nationkey"): "nation",
    ("supplier", "s_nationkey"): "nation", ("orders", "o_custkey"): "customer",
    ("lineitem", "l_orderkey"): "orders", ("lineitem", "l_partkey"): "part",
    ("lineitem", "l_suppkey"): "supplier", ("labels", "doc_id"): "documents",
}

MONETARY = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_extendedprice"}
SELECTION = {"o_orderstatus", "o_orderpriority", "c_mktsegment", "l_returnflag",
             "l_linestatus", "event_type", "lang", "role"}
TEXT = {("documents", "text"), ("benchmark", "text"), ("conversations", "text")}
HTML = {("pages", "html")}

# Computed (not stored) rows appended after a model's columns.
COMPUTED_ROWS: dict[str, list[tuple[str, str]]] = {
    "customer": [("order_ids", "one2many")],
    "orders": [("line_count", "integer")],
}

# Configured key fields per model (the decoded view shows these first).
KEY_FIELDS: dict[str, list[str]] = {"customer": ["c_name", "c_acctbal", "c_mktsegment"]}

# Column prefixes of the encoded catalog line, in column order.
CATALOG_LINE_PREFIXES = ("4^58", "4^58", "4^26", "4^33", "4^35", "4^28", "4^60000", "4^57", "4^60001")
# ---------------------------------------------------------------------------


def _field_type(model: str, column: str, storage: str) -> str:
    if (model, column) in FK_TARGETS:
        return "many2one"
    if column in MONETARY:
        return "monetary"
    if column in SELECTION:
        return "selection"
    if (model, column) in TEXT:
        return "text"
    if (model, column) in HTML:
        return "html"
    if storage in ("int", "bigint"):
        return "integer"
    if storage == "double":
        return "float"
    if storage.startswith("timestamp"):
        return "datetime"
    if storage.startswith("array"):
        return "binary"
    return "char"


_COLUMNS_SEEN: dict[str, dict[str, list[tuple[str, str]]]] = {}


def table_columns(spark: SparkSession, sf_dir: str) -> dict[str, list[tuple[str, str]]]:
    """Column lists read from the Parquet footers of the tables (no data scan);
    remembered per folder for the life of the process."""
    if sf_dir not in _COLUMNS_SEEN:
        out = {}
        for model in TABLE_COLUMNS:
            schema = read_table(spark, sf_dir, model).schema
            out[model] = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        _COLUMNS_SEEN[sf_dir] = out
    return _COLUMNS_SEEN[sf_dir]


def catalog_rows(exclude_models: tuple[str, ...] = (),
                 columns: dict[str, list[tuple[str, str]]] | None = None) -> list[dict]:
    """Catalog rows in file order; ``line_no`` counts from 1 over all models."""
    columns = columns or TABLE_COLUMNS
    id_field: dict[str, int] = {}
    for model, cols in columns.items():
        key = KEY_COLUMNS.get(model)
        for pos, (name, _) in enumerate(cols, start=1):
            if name == key:
                id_field[model] = MODEL_IDS[model] * 100 + pos
    rows: list[dict] = []
    line_no = 0
    for model, cols in columns.items():
        mid = MODEL_IDS[model]
        entries = [(name, _field_type(model, name, st), True) for name, st in cols]
        entries += [(name, ftype, False) for name, ftype in COMPUTED_ROWS.get(model, [])]
        for pos, (name, ftype, stored) in enumerate(entries, start=1):
            line_no += 1
            fname = "id" if name == KEY_COLUMNS.get(model) else name
            fid = mid * 100 + pos
            if ftype == "many2one":
                target = FK_TARGETS[(model, name)]
                location = f"{target}.id"
                pm, pf = str(MODEL_IDS[target]), str(id_field[target])
            elif not stored:
                location, pm, pf = "Computed", "", ""
            else:
                location, pm, pf = f"{model}.{fname}", str(mid), str(fid)
            if model in exclude_models:
                continue
            rows.append(dict(
                line_no=line_no, model_id=mid, field_id=fid, field_name=fname,
                field_label=fname.replace("_", " "), field_type=ftype, model_name=model,
                primary_data_location=location, stored=stored,
                primary_model_id=pm, primary_field_id=pf,
            ))
    return rows


def catalog_line(row: dict) -> str:
    """One encoded catalog line: nine ``prefix*value`` columns joined by a pipe."""
    ref = f"{row['primary_model_id']}^{row['primary_field_id']}*" if row["primary_model_id"] else ""
    values = [row["model_id"], row["field_id"], row["field_name"], row["field_label"],
              row["field_type"], row["model_name"], row["primary_data_location"],
              "Yes" if row["stored"] else "No", ref]
    return "|".join(f"{p}*{v}" for p, v in zip(CATALOG_LINE_PREFIXES, values))


def fields_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(model_name, field_name, n_values)``: how many rows of each table hold a value in each
    column. One aggregate per table (partial counts in the tasks), a row per column."""
    out = None
    for model, cols in table_columns(spark, sf_dir).items():
        counts = read_table(spark, sf_dir, model).agg(*[F.count(name).alias(name) for name, _ in cols])
        names = [F.struct(F.lit(model).alias("model_name"), F.lit("id" if name == KEY_COLUMNS.get(model) else name).alias("field_name"),
                          F.col(name).alias("n_values")) for name, _ in cols]
        rows = counts.select(F.inline(F.array(*names)))
        out = rows if out is None else out.unionByName(rows)
    return out


def catalog_text_df(spark: SparkSession, sf_dir: str | None = None,
                    exclude_models: tuple[str, ...] = (), seen: bool = False) -> DataFrame:
    """The catalog as text lines ``(line_no, value)``, as ``read_catalog_text`` gives.

    With ``sf_dir`` the column lists come from the tables' own schemas; with
    ``seen`` only columns that hold a value in some row are listed (and
    computed fields), so the lines follow from the tables' rows.
    """
    cols = table_columns(spark, sf_dir) if sf_dir else None
    rows = catalog_rows(exclude_models, cols)
    data = [(r["line_no"], catalog_line(r), r["model_name"], r["field_name"], r["stored"]) for r in rows]
    lines = spark.createDataFrame(data, "line_no long, value string, model_name string, field_name string, stored boolean")
    if seen:
        held = fields_with_values(spark, sf_dir).filter("n_values > 0").select("model_name", "field_name", F.lit(True).alias("held"))
        lines = lines.join(held, ["model_name", "field_name"], "left").filter("held OR NOT stored")
    return lines.select("line_no", "value")


def catalog(spark: SparkSession, sf_dir: str | None = None,
            exclude_models: tuple[str, ...] = (), seen: bool = False) -> DataFrame:
    """The parsed catalog table (S2-S3 applied to the catalog text)."""
    from ..sources.catalog_text import parse_catalog

    return parse_catalog(catalog_text_df(spark, sf_dir, exclude_models, seen)).good


def key_fields(spark: SparkSession) -> DataFrame:
    data = [(m, f, i) for m, fs in KEY_FIELDS.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(data, "model_name string, field_name string, key_rank int")


def models_with_id() -> list[str]:
    return [m for m in TABLE_COLUMNS if m in KEY_COLUMNS]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def record_view(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """Records of one model as the catalog names them: key column renamed ``id``.

    Computed fields are derived by Spark: ``orders.line_count`` is a partial +
    final count of lineitem per order joined back on the key (no per-key
    collection). ``customer.order_ids`` is not materialised: a one2many list
    is unbounded per customer, so the field is read as absent and encodes as
    the empty value (documented quirk, see README).
    """
    from ..operators.common import spread

    df = spread(read_table(spark, sf_dir, model))
    key = KEY_COLUMNS.get(model)
    if key:
        df = df.withColumnRenamed(key, "id")
    if model == "orders":
        counts = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                  .agg(F.count(F.lit(1)).alias("line_count"))
                  .withColumnRenamed("l_orderkey", "id"))
        df = (df.join(counts, "id", "left")
              .withColumn("line_count", F.coalesce(F.col("line_count"), F.lit(0).cast("long"))))
    return df
