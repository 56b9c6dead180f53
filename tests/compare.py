"""Run registered queries on Spark and their SQL on DuckDB and compare sorted rows.

usage: python tests/compare.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    columns, mine = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return took, len(mine), None, ""
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs_columns, theirs = rows_of(names, cursor.fetchall())
    oracle = time.time() - start
    if columns != theirs_columns:
        return took, len(mine), False, f"columns {columns} {theirs_columns}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return took, len(mine), False, f"{len(mine)} {len(theirs)} differ {len(a)}: {sorted(a)[:3]} {sorted(b)[:3]}"
    return took, len(mine), True, f"sql {oracle:.1f}s"


def main() -> None:
    import __spark_entry__ as entry
    from ntuple.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            took, n, same, note = compare(spark, con, sf_dir, name, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            took, n, same, note = 0.0, -1, False, f"{type(error).__name__}: {str(error)[:600]}"
        mark = {True: "ok", False: "BAD", None: "rows"}[same]
        print(f"{mark:4} {name:36} {took:6.1f}s {n:8} {note}", flush=True)
        if same is False:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
