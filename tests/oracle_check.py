"""Run registered queries in Spark and their SQL in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and the order-insensitive multiset of rows
(floats rounded to 6 places). Prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from coordspark.session import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return f"{name}: rows-only {len(srows)} rows ({t1 - t0:.1f}s)", True
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    sc, sr = rows_of(scols, srows)
    dc, dr = rows_of(dcols, drows)
    ok = sc == dc and sr == dr
    msg = f"{name}: spark={len(sr)} duck={len(dr)} cols_ok={sc == dc} values_ok={sr == dr} ({t1 - t0:.1f}s)"
    if not ok:
        if sc != dc:
            msg += f"\n   spark cols {sc}\n   duck  cols {dc}"
        else:
            a, b = set(sr), set(dr)
            for x in list(a - b)[:3]:
                msg += f"\n   only spark: {str(x)[:400]}"
            for x in list(b - a)[:3]:
                msg += f"\n   only duck : {str(x)[:400]}"
    return msg, ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from coordspark.plans.queries import QUERIES, SQL
    from coordspark.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            msg, ok = compare(spark, con, name, fn, SQL.get(name), sf_dir)
        except Exception as e:  # report and go on
            msg, ok = f"{name}: ERROR {type(e).__name__}: {str(e)[:600]}", False
        bad += not ok
        print(msg, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
