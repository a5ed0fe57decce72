"""Run registered queries next to their SQL and report differences: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shorelark.plans.standins import TABLES
from shorelark.session import build_session


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(canonical(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, sf_dir, name, fn, sql, show=3):
    t = time.time()
    cols, mine = spark_rows(fn(spark, sf_dir))
    took = time.time() - t
    n = sum(mine.values())
    if sql is None:
        return f"rows  {name}: {n} rows {took:.1f}s", n > 0
    t = time.time()
    other_cols, other = duck_rows(con, sql)
    duck_took = time.time() - t
    if cols != other_cols:
        return f"FAIL  {name}: columns {cols} vs {other_cols}", False
    if mine == other:
        return f"ok    {name}: {n} rows {took:.1f}s (duck {duck_took:.1f}s)", n > 0
    lines = [f"FAIL  {name}: {n} vs {sum(other.values())} rows, cols {cols}"]
    only, theirs = mine - other, other - mine
    lines += [f"   spark {r}" for r in sorted(only, key=str)[:show]]
    lines += [f"   duck  {r}" for r in sorted(theirs, key=str)[:show]]
    lines.append(f"   differing {sum(only.values())} / {sum(theirs.values())}")
    return "\n".join(x[:1500] for x in lines), False


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            text, ok = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:
            text, ok = f"ERROR {name}: {type(e).__name__} {str(e)[:900]}", False
        bad += not ok
        print(text, flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
