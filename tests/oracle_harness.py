"""Run a registered Spark query and its DuckDB oracle on the same tables and compare.

Comparison is the driver's: column names (sorted), row count, and the
multiset of rows with exact values (floats compared bit for bit).
"""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", None if math.isnan(v) else v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (dt.date, dt.datetime)):
        return ("d", v.isoformat())
    if v is None:
        return ("n", None)
    return ("s", str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


SPARK_TO_DUCK = {"LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
                 "DateType()": "DATE", "BooleanType()": "BOOLEAN", "IntegerType()": "INTEGER"}


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_types = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols),
           "types_match": s_types == d_types}
    if not (out["columns_match"] and out["types_match"]):
        out["detail"] = f"spark {sorted(s_types.items())} vs oracle {sorted(d_types.items())}"
        out["match"] = False
        return out
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    out["match"] = a == b
    if not out["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["detail"] = f"first diffs: {diff}" if diff else "row counts differ"
    return out


def main(argv=None) -> int:
    """``python tests/oracle_harness.py [sf_dir] [key ...]``: compare queries with their oracle."""
    import os
    import sys
    import time

    argv = sys.argv[1:] if argv is None else argv
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as E
    from promolens.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark = local_session("local[8]")
    con = duck(sf)
    bad = 0
    for name, fn in E.queries().items():
        if name not in E.oracle_sql():
            continue
        if only and name not in only:
            continue
        t0 = time.time()
        r = compare(fn(spark, sf), con, E.oracle_sql()[name])
        bad += not r["match"]
        print(f"{'OK ' if r['match'] else 'BAD'} {name:28s} {time.time() - t0:5.1f}s "
              f"rows={r['spark_rows']}/{r['oracle_rows']} {r.get('detail', '') if not r['match'] else ''}",
              flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
