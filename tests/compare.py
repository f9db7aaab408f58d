"""Runs queries against their SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"max_temp_directory_size": "1GB"})
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def _norm(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(cols: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(cols)}"]
    if got == want:
        return []
    a, b = set(map(str, got)), set(map(str, want))
    return [f"{len(got)} and {len(want)} rows", *[f"only here: {x}" for x in sorted(a - b)[:3]], *[f"only in SQL: {x}" for x in sorted(b - a)[:3]]]
