"""Comparison of a Spark result with DuckDB's answer to the same question."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        v = float(v)
        return "NaN" if v != v else f"{v + 0.0:.9g}"
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(int(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())
