"""Counting and profiling. Results come as rows, one per column or value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions.values import doubles
from hirelake.operators.quantiles import quantiles_and
from hirelake.sources.layers import side_by_side


def _per_column(df: DataFrame, cols: Sequence[str], fields: Mapping[str, object]) -> DataFrame:
    """One pass over `df`, then one row per column; `fields` map a name to a function of the column name."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[make(c).alias(n) for n, make in fields.items()])
            for c in cols
        ]
    )
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    return _per_column(df, df.columns, {"nulls": lambda c: F.count_if(F.col(c).isNull())})


def table_info(df: DataFrame) -> DataFrame:
    """Type, non-null count and row count of every column."""
    types = dict(df.dtypes)
    return _per_column(
        df,
        df.columns,
        {
            "data_type": lambda c: F.lit(types[c]),
            "non_null": lambda c: F.count(c),
            "row_count": lambda c: F.count(F.lit(1)),
        },
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


QUARTILES = (0.25, 0.5, 0.75)
_FIGURES = "mean double, std double, min double, q25 double, median double, q75 double, max double"


def _figures(df: DataFrame, cols: Sequence[str], more: Sequence[Column]) -> tuple[dict[str, tuple], list]:
    """Mean, deviation, least, quartiles and largest of columns of doubles, and `more` aggregates, by two passes in all."""
    own = [f(c) for c in cols for f in (F.avg, F.stddev_samp, F.min, F.max)]
    quartiles, row = quantiles_and(df, cols, QUARTILES, [*own, *more])
    figures = {}
    for i, c in enumerate(cols):
        mean, deviation, least, largest = row[4 * i : 4 * i + 4]
        figures[c] = (mean, deviation, least, *quartiles[c], largest)
    return figures, row[len(own) :]


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the numeric columns."""
    cols = list(cols or numeric_columns(df))
    figures, counts = _figures(doubles(df, cols), cols, [F.count(c) for c in cols])
    rows = [(c, n, *figures[c]) for c, n in zip(cols, counts)]
    return df.sparkSession.createDataFrame(rows, f"column_name string, values bigint, {_FIGURES}")


def count_distinct(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias("distinct_values"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; keys with a null in them are left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))


def value_counts_sorted(df: DataFrame, col: str) -> DataFrame:
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.orderBy(col)


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def benefits_count(df: DataFrame, key: str = "job_id", col: str = "type", mode: str = "auto") -> DataFrame:
    """Benefits per key: list lengths when `col` holds lists, else 1 for every key there is.

    `mode` can be `length`, `presence`, or `rows`, which counts a table with one row per benefit as
    if it had been gathered to lists; `auto` goes by the column's type. A list that goes on over
    several rows of one key counts as one. Null keys are left out.
    """
    is_list = col in df.columns and isinstance(df.schema[col].dataType, T.ArrayType)
    keyed = df.filter(F.col(key).isNotNull())
    if mode == "rows":
        return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("benefits_count"))
    if mode == "length" or (mode == "auto" and is_list):
        return keyed.groupBy(key).agg(F.sum(F.size(col)).alias("benefits_count"))
    return keyed.select(key).distinct().withColumn("benefits_count", F.lit(1).cast("bigint"))


def profile_table(df: DataFrame) -> DataFrame:
    """Type, rows and nulls of every column, with the figures of `describe` where it is numeric."""
    types, numeric = dict(df.dtypes), numeric_columns(df)
    counts = [F.count(F.lit(1)), *[F.count(c) for c in df.columns]]
    figures, (rows, *filled) = _figures(doubles(df, numeric), numeric, counts)
    none = (None,) * len(_FIGURES.split(","))
    found = [(c, types[c], rows, rows - n, *figures.get(c, none)) for c, n in zip(df.columns, filled)]
    schema = f"column_name string, data_type string, row_count bigint, nulls bigint, {_FIGURES}"
    return df.sparkSession.createDataFrame(found, schema)


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    profiles = side_by_side(tables, lambda name, df: profile_table(df).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, profiles.values())
