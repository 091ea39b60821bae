"""Epoch numbers, date keys and date parts. Timestamps are zone-less, so no session setting matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.fixed_values import MAX_EPOCH_MS, MAX_EPOCH_S
from hirelake.functions import as_column
from hirelake.functions.values import to_double

DATE_KEY_FORMAT = "yyyyMMdd"


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def epoch_ms_to_ts(c: Column | str) -> Column:
    """Milliseconds since 1970 as a timestamp; null outside the years 1677 to 2262."""
    ms = to_double(c)
    whole = F.floor(ms)
    micros = whole * F.lit(1000) + F.round((ms - whole) * 1000).cast("bigint")
    return F.when(F.abs(ms) <= MAX_EPOCH_MS, F.timestamp_add("MICROSECOND", micros, _epoch()))


def epoch_fallback_parse(c: Column | str) -> Column:
    """Milliseconds since 1970, or else ordinary date text, value by value."""
    parsed = as_column(c).cast("string").try_cast("timestamp_ntz")
    in_range = F.year(parsed).between(1678, 2261)
    return F.coalesce(epoch_ms_to_ts(c), F.when(in_range, parsed))


def epoch_s_to_date(c: Column | str) -> Column:
    seconds = to_double(c)
    days = F.floor(seconds / 86400).cast("int")
    return F.when(F.abs(seconds) <= MAX_EPOCH_S, F.date_from_unix_date(days))


def format_date_key(c: Column | str) -> Column:
    """The day as eight digits, by arithmetic: no formatter, no session zone."""
    c = as_column(c)
    number = F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)
    return F.lpad(number.cast("string"), 8, "0")


def parse_date_key(c: Column | str, fmt: str = DATE_KEY_FORMAT) -> Column:
    return F.try_to_date(as_column(c), fmt)


def date_parts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns(
        {"year": F.year(F.col(col)), "month": F.month(F.col(col)), "day": F.dayofmonth(F.col(col))}
    )
