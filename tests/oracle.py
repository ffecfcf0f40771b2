"""Compares a query with its SQL on DuckDB as multisets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, sql: str, sf_dir: str) -> None:
    con = connect(sf_dir)
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns), (df.columns, rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got == want, (sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
