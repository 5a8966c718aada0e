"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        c.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return tuple(plain(y) for y in x)
    return round(x, 6) if isinstance(x, float) else x


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def assert_same(df, sql: str, con) -> None:
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, told.fetchall())
