"""Spark queries against their SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


def rows(values):
    return sorted((tuple(None if isinstance(v, float) and v != v else v for v in r) for r in values), key=lambda r: [repr(v) for v in r])


def assert_equal(spark, con, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == rows(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
