"""Compares a query's rows with DuckDB's over the same Parquet files."""

import decimal

import duckdb
import numpy as np

from tessera.sources.model import TABLES


def connect(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    out = con.sql(sql)
    assert sorted(out.columns) == names
    at = [out.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
    assert got == want
