"""Currency, pay period and salary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.fixed_values import CLEANING_RATES, MODEL_RATES, PERIODS_PER_YEAR
from hirelake.functions import as_column


def _factor(code: Column, factors: Mapping[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for code_, f in factors.items() for x in (code_, float(f))])
    return F.coalesce(table[code], F.lit(1.0))


def currency_to_usd(
    salary: Column | str,
    currency: Column | str,
    rates: Mapping[str, float] | None = None,
    guarded: bool = False,
) -> Column:
    """Salary in USD; an unknown or null currency counts as USD.

    `guarded` leaves USD and non-positive salaries alone and has its own default rates.
    """
    salary, currency = as_column(salary), as_column(currency)
    rates = rates or (MODEL_RATES if guarded else CLEANING_RATES)
    converted = salary * _factor(currency, rates)
    if not guarded:
        return converted
    return F.when((currency != "USD") & (salary > 0), converted).otherwise(salary)


def annualize_salary(
    salary: Column | str,
    period: Column | str,
    factors: Mapping[str, float] | None = None,
    guarded: bool = False,
) -> Column:
    """Salary per year; an unknown or null period counts as yearly."""
    salary = as_column(salary)
    period = F.upper(F.coalesce(as_column(period), F.lit("YEARLY")))
    yearly = salary * _factor(period, factors or PERIODS_PER_YEAR)
    if not guarded:
        return yearly
    return F.when((period != "YEARLY") & (salary > 0), yearly).otherwise(salary)


def unify_salary(med: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Median, else the middle of both ends, else the one end there is."""
    med, lo, hi = as_column(med), as_column(lo), as_column(hi)
    return F.coalesce(med, (lo + hi) / 2, lo, hi)


def clip_upper_const(c: Column | str, cap: float | None) -> Column:
    """The value as a double, at most `cap`, if there is one; nulls stay null, and NaN is read as null."""
    value = F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double"))
    return value if cap is None else F.when(value > cap, F.lit(float(cap))).otherwise(value)
