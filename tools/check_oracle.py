"""Run registered queries on Spark and DuckDB side by side: ``check_oracle.py [folder] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventide.plans import TABLES, Tables, load_all  # noqa: E402
from eventide.session import local_session  # noqa: E402


def plain(value):
    """A comparable, hashable form of a cell of either engine."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(columns_a, rows_a, columns_b, rows_b) -> str:
    if sorted(columns_a) != sorted(columns_b):
        return f"columns differ: {sorted(columns_a)} / {sorted(columns_b)}"
    pick_a = [columns_a.index(c) for c in sorted(columns_a)]
    pick_b = [columns_b.index(c) for c in sorted(columns_b)]
    a = sorted((tuple(plain(r[i]) for i in pick_a) for r in rows_a), key=repr)
    b = sorted((tuple(plain(r[i]) for i in pick_b) for r in rows_b), key=repr)
    if len(a) != len(b):
        return f"row count {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "ok" if not bad else f"{len(bad)} rows differ, first:\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT"}


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con, failed = local_session(8), duck(folder), 0
    found = load_all()
    for name in args or found:
        q = found[name]
        start = time.time()
        try:
            df = q.build(Tables(spark, folder))
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {str(e)[:700]}", flush=True)
            failed += 1
            continue
        took = time.time() - start
        if not q.sql:
            print(f"{name:32s} {len(rows):8d} rows {took:6.2f}s  rows only", flush=True)
            continue
        try:
            start = time.time()
            cur = con.execute(q.sql)
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            other = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK ERROR {str(e)[:700]}", flush=True)
            failed += 1
            continue
        verdict = compare(df.columns, rows, names, other)
        types = [f"{c}:{k}/{kinds.get(c)}" for c, k in df.dtypes if KINDS.get(k, k) != kinds.get(c)]
        if types:
            verdict += f"  TYPES {types}"
        failed += verdict != "ok"
        print(f"{name:32s} {len(rows):8d} rows {took:6.2f}s duck {time.time() - start:5.2f}s  {verdict}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
