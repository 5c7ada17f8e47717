"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_returns_rows_with_stable_schema(spark):
    se = _entry_module()
    a = se.entry(spark)
    b = se.entry(spark)
    assert a.schema == b.schema and a.columns == ["record_id", "model_name", "decoded_text"]
    assert a.count() > 0


def test_every_sql_has_a_query_and_names_are_plain(spark):
    se = _entry_module()
    q, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 100
    for name in q:
        assert name.isidentifier()
