"""Projections and filters that skip absent columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import DATE_KEY_FORMAT, parse_date_key


def clean_name(name: str) -> str:
    return name.strip().replace('"', "").lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide once normalised: {names}")
    return df.toDF(*names)


def drop_columns_if_exist(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def select_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def resolve_column(df: DataFrame, candidates: Sequence[str], out: str) -> DataFrame:
    """Copy the first of `candidates` the frame has to `out`; without any the frame is unchanged."""
    found = next((c for c in candidates if c in df.columns), None)
    return df if found in (None, out) else df.withColumn(out, F.col(found))


def constant_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def fill_per_column(df: DataFrame, mapping: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in mapping.items() if c in df.columns})


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def filter_valid_dates(df: DataFrame, col: str, fmt: str = DATE_KEY_FORMAT) -> DataFrame:
    return df.filter(parse_date_key(col, fmt).isNotNull())


def is_null_predicates(df: DataFrame, col: str, values: Sequence = ()) -> DataFrame:
    """Flags per row: null, not null and, given `values`, not one of them (true for null)."""
    flags = {"is_null": F.col(col).isNull(), "is_not_null": F.col(col).isNotNull()}
    if values:
        flags["not_in"] = ~F.coalesce(F.col(col).isin(*values), F.lit(False))
    return df.withColumns(flags)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


def union_chunks(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def limit_n(df: DataFrame, n: int, order_by: Sequence | None = None) -> DataFrame:
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def preview(df: DataFrame, n: int = 5, order_by: Sequence | None = None) -> DataFrame:
    return limit_n(df, n, order_by)
