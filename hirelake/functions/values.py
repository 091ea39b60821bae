"""Null handling, casts and text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.fixed_values import NOT_SPECIFIED, UNKNOWN
from hirelake.functions import as_column


def to_double(c: Column | str) -> Column:
    """Number as double; text that is no number, and NaN, become null."""
    c = as_column(c)
    # A trailing d or f is a Java literal suffix, which the cast would accept. The type test
    # folds to a constant, so number columns never pay for the pattern.
    suffixed = (F.typeof(c) == "string") & c.cast("string").rlike("[0-9.][dDfF]\\s*$")
    number = c.try_cast("double")
    return F.when(~suffixed, F.nanvl(number, F.lit(None).cast("double")))


def doubles(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The frame with `cols` as doubles without NaN; each type gets the cheapest expression for it."""
    types = dict(df.dtypes)
    exact = ("bigint", "int", "smallint", "tinyint")

    def double(c: str) -> Column:
        return F.col(c).cast("double") if types[c] in exact else to_double(c)

    return df.withColumns({c: double(c) for c in cols})


def fill_constant(c: Column | str, value) -> Column:
    return F.coalesce(as_column(c), F.lit(value))


def replace_missing_token(
    c: Column | str, tokens: Iterable[str] = ("nan",), value: str = NOT_SPECIFIED
) -> Column:
    c = as_column(c)
    return F.when(c.isNull() | c.isin(*tokens), F.lit(value)).otherwise(c)


def replace_null_with_unknown(c: Column | str, value: str = UNKNOWN) -> Column:
    return F.coalesce(as_column(c), F.lit(value))


def replace_exact_value(c: Column | str, old: str, new: str) -> Column:
    c = as_column(c)
    return F.when(c == old, F.lit(new)).otherwise(c)


def zip_to_string(c: Column | str) -> Column:
    """Text of a zip code. A double keeps its `.0` and is never written with an exponent."""
    c = as_column(c)
    number = c.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    exponent = (F.typeof(c) == "double") & c.cast("string").contains("E")
    return F.when(exponent & whole, F.concat(number.try_cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        c.cast("string")
    )


def cast_numeric_coerce(c: Column | str, default: int = 0) -> Column:
    """Whole number, cut towards zero; whatever is no number becomes `default`."""
    c = as_column(c)
    return F.coalesce(c.try_cast("bigint"), to_double(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def cast_int_trunc(c: Column | str) -> Column:
    return as_column(c).cast("bigint")


def cast_bool_nonzero(c: Column | str) -> Column:
    return F.coalesce(to_double(c), F.lit(0.0)) != 0.0


def cast_string_nulltoken(c: Column | str, token: str = "None") -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(token))


def upper_case(c: Column | str) -> Column:
    return F.upper(as_column(c))


def prefix_key(key: Column | str, name: Column | str, n: int = 3, sep: str = "_") -> Column:
    """Key text, separator, first `n` characters of the name; null parts are spelled out."""
    return F.concat(
        cast_string_nulltoken(key, "nan"), F.lit(sep), F.substring(cast_string_nulltoken(name), 1, n)
    )


def concat_key_fallback(df: DataFrame, cols: Iterable[str], default: str = "UNK") -> Column:
    """Concatenation of those of `cols` the frame has, or `default` when it has none."""
    present = [F.col(c).cast("string") for c in cols if c in df.columns]
    return F.concat(*present) if present else F.lit(default)
