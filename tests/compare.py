"""Runs queries beside their SQL in DuckDB and compares rows as the correctness gate does."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        name = f.removesuffix(".parquet")
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, folder: str, query, sql: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(folder).execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return f"{len(ours[1])} and {len(theirs[1])} rows; only here {sorted(a - b, key=repr)[:4]}, only in SQL {sorted(b - a, key=repr)[:4]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tessaria.session import local_session

    folder, *names = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    for n in qs:
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            said = compare(spark, folder, qs[n], sqls[n]) if n in sqls else f"no SQL, {qs[n](spark, folder).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{n}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
