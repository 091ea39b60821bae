"""Run a registered query and its oracle SQL on one data folder and compare whole results."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return "NaN" if isinstance(value, float) and math.isnan(value) else float(value)
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None when both results hold the same columns and the same rows, else what differs."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    expected, actual = _rows(columns, result.fetchall()), _rows(df.columns, df.collect())
    if expected == actual:
        return None
    extra, missing = actual - expected, expected - actual
    sample = f"{list(extra)[:3]} vs {list(missing)[:3]}"
    return f"{actual.total()} rows vs {expected.total()}, {extra.total()} extra, {missing.total()} missing: {sample}"
