"""Runs registered queries next to their SQL in DuckDB and compares values.

usage: python tests/check.py [sf] [name or prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql):
    t0 = time.time()
    spark_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    t2 = time.time()
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    elif len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    else:
        a, b = canonical(df.columns, spark_rows), canonical(names, duck_rows)
        bad = [(x, y) for x, y in zip(a, b) if x != y or [type(i) for i in x] != [type(i) for i in y]]
        if bad:
            problems.append(f"{len(bad)} of {len(a)} rows differ ({sorted(names)}), first: {bad[0]}")
    if not spark_rows:
        problems.append("no rows")
    return problems, len(spark_rows), t1 - t0, t2 - t1


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from corvane.session import local_session

    args = sys.argv[1:]
    sf = f"/root/testdata/sf{args.pop(0) if args and args[0][0].isdigit() else '0.01'}"
    spark, con, failed = local_session(), duck(sf), 0
    sqls = oracle_sql()
    todo = {n: f for n, f in queries().items() if not args or any(n == a or n.startswith(a + "_") for a in args)}
    for name, fn in todo.items():
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problems, n, ts, td = compare(df, con, sqls[name])
            else:
                n, td = len(df.collect()), 0.0
                problems = [] if n else ["no rows"]
            ts = time.time() - t - td
            print(f"{'FAIL' if problems else 'ok  '} {name:32s} rows={n:<8d} spark={ts:.2f}s sql={td:.2f}s {'' if name in sqls else '(rows only)'}")
            for p in problems:
                print("      ", p[:900])
            text = df._jdf.queryExecution().executedPlan().toString()
            for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
                if bad in text:
                    print("       note: plan has", bad)
        except Exception as e:  # noqa: BLE001
            problems = [str(e)]
            print(f"FAIL {name:32s} {type(e).__name__}: {str(e)[:900]}")
        failed += bool(problems)
    print(f"{len(todo) - failed} of {len(todo)} good")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
