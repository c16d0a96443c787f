"""Compare a query with DuckDB on the same tables."""

import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def rows(df) -> tuple[list, list]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list, list]:
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
