"""Raw tables to cleaned tables. Absent optional columns are skipped throughout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.fixed_values import (
    CLEANING_RATES,
    COMPANY_DEFAULTS,
    IQR_FACTOR,
    JOB_COLUMNS_DROPPED,
    PERIODS_PER_YEAR,
    SALARY_COLUMNS,
    UNKNOWN,
)
from hirelake.functions.dates import epoch_fallback_parse, epoch_ms_to_ts, epoch_s_to_date
from hirelake.functions.money import annualize_salary, currency_to_usd, unify_salary
from hirelake.functions.values import (
    cast_bool_nonzero,
    cast_int_trunc,
    fill_constant,
    replace_exact_value,
    replace_missing_token,
    replace_null_with_unknown,
    to_double,
    zip_to_string,
)
from hirelake.operators.ordering import LIST_LIMIT, collect_list_by_key, sequential_id
from hirelake.operators.projection import (
    drop_columns_if_exist,
    drop_null_rows,
    fill_per_column,
    normalize_columns,
    resolve_column,
)
from hirelake.operators.quantiles import iqr_cap, median_impute
from hirelake.sources.csv import SEQ

ROW_NUMBERS = ("job_id_modify", "company_id_modify")


def _is_text(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() == "string"


def _repair_job_columns(df: DataFrame) -> DataFrame:
    df = drop_columns_if_exist(normalize_columns(df), JOB_COLUMNS_DROPPED)
    repairs = {
        "zip_code": lambda c: replace_missing_token(zip_to_string(c)),
        "formatted_experience_level": replace_missing_token,
        "original_listed_time": _listing_time(df),
        "company_id": lambda c: cast_int_trunc(fill_constant(to_double(c), -1.0)),
        "views": lambda c: cast_int_trunc(fill_constant(to_double(c), 0.0)),
        "remote_allowed": cast_bool_nonzero,
    }
    return df.withColumns({c: repair(c) for c, repair in repairs.items() if c in df.columns})


def _has_text(df: DataFrame, col: str) -> bool:
    return col in df.columns and _is_text(df, col)


def clean_job_values(
    df: DataFrame,
    rates: Mapping[str, float] = CLEANING_RATES,
    factors: Mapping[str, float] = PERIODS_PER_YEAR,
    annualize: bool = True,
    k: float = IQR_FACTOR,
) -> DataFrame:
    """Cleaned jobs before the rows are numbered, for readers that need no number."""
    df = _repair_job_columns(df)
    if "normalized_salary" in df.columns:
        salary = to_double("normalized_salary")
        if "currency" in df.columns:
            salary = currency_to_usd(salary, "currency", rates)
        if "pay_period" in df.columns and annualize:
            salary = annualize_salary(salary, "pay_period", factors)
        known = {"currency": F.lit("USD"), "pay_period": F.lit("YEARLY")}
        df = df.withColumns(
            {"normalized_salary": salary, **{c: v for c, v in known.items() if c in df.columns}}
        )
        df = iqr_cap(df, ["normalized_salary"], k)
    return df


def clean_jobs(
    df: DataFrame,
    order_by: Sequence[str] = (SEQ,),
    rates: Mapping[str, float] = CLEANING_RATES,
    factors: Mapping[str, float] = PERIODS_PER_YEAR,
    annualize: bool = True,
    k: float = IQR_FACTOR,
) -> DataFrame:
    """`annualize=False` trusts the salary column to be a yearly figure already.

    Values come before numbers, so the passes for the cap read three columns of the source.
    """
    return sequential_id(clean_job_values(df, rates, factors, annualize, k), order_by, ROW_NUMBERS).drop(SEQ)


def listing_times(df: DataFrame) -> DataFrame:
    """Jobs with their listing time repaired and nothing else done."""
    df = normalize_columns(df)
    if "original_listed_time" not in df.columns:
        return df
    return df.withColumn("original_listed_time", _listing_time(df)("original_listed_time"))


def _listing_time(df: DataFrame):
    return epoch_fallback_parse if _has_text(df, "original_listed_time") else epoch_ms_to_ts


def clean_jobs_notebook(df: DataFrame, order_by: Sequence[str] = (SEQ,), k: float = IQR_FACTOR) -> DataFrame:
    """The exploratory variant: salaries keep their currency and period, null codes become `Unknown`."""
    df = _repair_job_columns(df)
    codes = [c for c in ("currency", "pay_period") if c in df.columns]
    df = df.withColumns({c: replace_null_with_unknown(c) for c in codes})
    salaries = [c for c in ("normalized_salary",) if c in df.columns]
    return sequential_id(iqr_cap(df, salaries, k), order_by, ROW_NUMBERS).drop(SEQ)


def _unified_salary(df: DataFrame):
    med, lo, hi = (
        to_double(c) if c in df.columns else F.lit(None).cast("double")
        for c in ("med_salary", "min_salary", "max_salary")
    )
    return unify_salary(med, lo, hi)


def clean_salaries(
    df: DataFrame, factors: Mapping[str, float] = PERIODS_PER_YEAR, k: float = IQR_FACTOR
) -> DataFrame:
    """One yearly salary per row. The currency is left as it is."""
    df = normalize_columns(df)
    salary = _unified_salary(df)
    if "pay_period" in df.columns:
        salary = annualize_salary(salary, "pay_period", factors)
        df = df.withColumns({"normalized_salary": salary, "pay_period": F.lit("YEARLY")})
    else:
        df = df.withColumn("normalized_salary", salary)
    return drop_columns_if_exist(iqr_cap(df, ["normalized_salary"], k), SALARY_COLUMNS)


def clean_salaries_notebook(df: DataFrame, k: float = IQR_FACTOR) -> DataFrame:
    """The exploratory variant: source columns stay, each is capped on its own, nothing is annualised."""
    df = normalize_columns(df)
    df = df.withColumn("raw_salary", _unified_salary(df))
    return iqr_cap(df, [c for c in ("max_salary", "med_salary", "min_salary", "raw_salary") if c in df.columns], k)


def clean_benefits(
    df: DataFrame, order_by: Sequence[str] = (SEQ,), max_items: int = LIST_LIMIT
) -> DataFrame:
    """Benefit types per job in order; a row is one part of a job's list, with up to `max_items` of them."""
    df = drop_columns_if_exist(normalize_columns(df), ["inferred"])
    if "job_id" not in df.columns or "type" not in df.columns:
        return df
    return collect_list_by_key(df, "job_id", "type", order_by, max_items)


def clean_employee_counts(df: DataFrame) -> DataFrame:
    df = normalize_columns(df)
    if "time_recorded" not in df.columns:
        return df
    if _is_text(df, "time_recorded"):
        parsed = F.col("time_recorded").try_cast("date")
        return df.withColumn("time_recorded", F.coalesce(epoch_s_to_date("time_recorded"), parsed))
    return df.withColumn("time_recorded", epoch_s_to_date("time_recorded"))


def clean_industries(df: DataFrame) -> DataFrame:
    """Null names become `Unknown`; a column `industry_name` is also given as `industry`."""
    df = normalize_columns(df)
    named = "industry_name" if "industry_name" in df.columns else "industry"
    if named not in df.columns:
        return df
    df = df.withColumn(named, replace_null_with_unknown(named))
    return resolve_column(df, ["industry_name", "industry"], "industry")


def clean_companies(df: DataFrame) -> DataFrame:
    """The median size counts rows without a name, which are dropped only afterwards."""
    df = fill_per_column(normalize_columns(df), COMPANY_DEFAULTS)
    if "company_size" in df.columns:
        df = median_impute(df, "company_size")
    if "name" in df.columns:
        df = drop_null_rows(df, ["name"])
    places = [c for c in ("zip_code", "state") if c in df.columns]
    return df.withColumns({c: replace_exact_value(F.col(c).cast("string"), "0", UNKNOWN) for c in places})
