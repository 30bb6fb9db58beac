"""Run named queries in Spark and in DuckDB on the same tables and compare every value.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "NULL" if v != v else repr(round(v, 9))
        if v is None:
            return "NULL"
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None).isoformat()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return f"{type(v).__name__}:{v}"

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    spent = time.time() - t0
    if sql is None:
        return f"rows-only {len(rows):>8} rows {spent:6.1f}s", True
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck = time.time() - t0
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS spark={sorted(df.columns)} duckdb={sorted(names)}", False
    a, b = canonical(rows, df.columns), canonical(want, names)
    if a == b:
        return f"ok        {len(a):>8} rows {spent:6.1f}s (duckdb {duck:.1f}s)", True
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
    return f"MISMATCH  {len(a)} vs {len(b)} rows\n   cols {sorted(names)}\n   spark  {only_a}\n   duckdb {only_b}", False


def main():
    import __spark_entry__ as e
    from saidso.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    picked = args[1:] or list(e.queries())
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in picked:
        try:
            text, ok = compare(spark, con, name, e.queries()[name], e.oracle_sql().get(name), sf_dir)
        except Exception as err:  # report every query, not just the first failure
            text, ok = f"ERROR {type(err).__name__}: {str(err)[:1500]}", False
        bad += not ok
        print(f"{name:<28} {text}", flush=True)
    print("all good" if not bad else f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
