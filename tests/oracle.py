"""Side-by-side comparison of the registered queries with their SQL on DuckDB.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("tinyint", "smallint", "int", "integer", "bigint", "long", "short", "byte")) and "[" not in t:
        return "int"
    if t.startswith(("double", "float")) and "[" not in t:
        return "float"
    if t.startswith(("varchar", "string")) and "[" not in t:
        return "str"
    if t.startswith("bool"):
        return "bool"
    if t.startswith("array") or t.endswith("[]"):
        return "list"
    if t.startswith("timestamp"):
        return "ts"
    return t


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def compare(spark, con, sf_dir: str, query, sql: str | None) -> tuple[str, int, float]:
    start = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return ("rows-only" if rows else "EMPTY"), len(rows), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: _kind(str(d[1])) for d in cur.description}
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(set(names) ^ set(df.columns))}", len(rows), took
    for n, t in df.dtypes:
        if _kind(t) != kinds[n]:
            return f"TYPE {n}: {t} vs {kinds[n]}", len(rows), took
    order = sorted(names)
    got = sorted(tuple(_norm(r[n]) for n in order) for r in rows)
    pos = [names.index(n) for n in order]
    want = sorted(tuple(_norm(r[p]) for p in pos) for r in want_rows)
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", len(rows), took
    for g, w in zip(got, want):
        if g != w:
            diff = [(n, a[:120], b[:120]) for n, a, b in zip(order, g, w) if a != b]
            return f"VALUES {diff[:3]}", len(rows), took
    return ("ok" if rows else "EMPTY"), len(rows), took


def main() -> None:
    from cohortlens.session import build
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                  spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            status, n, took = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            status, n, took = f"ERROR {type(e).__name__}: {" ".join(str(e).split())[:400]}", 0, 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{name:42s} {n:7d} {took:6.2f}s  {status}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
