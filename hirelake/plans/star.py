"""Cleaned tables to the star schema, and the report on top of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.fixed_values import (
    DIM_COMPANY_COLUMNS,
    FACT_COLUMNS,
    FACT_JOB_COLUMNS,
    FACT_SALARY_CAP,
    LOCATION_COLUMNS,
    UNKNOWN,
)
from hirelake.functions.dates import date_parts, format_date_key
from hirelake.functions.money import annualize_salary, clip_upper_const, currency_to_usd
from hirelake.functions.values import (
    cast_bool_nonzero,
    cast_numeric_coerce,
    cast_string_nulltoken,
    concat_key_fallback,
    fill_constant,
    prefix_key,
    to_double,
)
from hirelake.operators.ordering import dedupe
from hirelake.operators.profile import benefits_count
from hirelake.operators.projection import resolve_column, select_existing
from hirelake.operators.skew import HeavyKeys, heavy_keys, left_join_default
from hirelake.sources.csv import SEQ
from hirelake.sources.layers import require_columns

DIM_TIME_SCHEMA = "time_key string, year int, month int, day int"


def company_employee_join(
    companies: DataFrame,
    employee_counts: DataFrame | None,
    order_by: Sequence[str] = (SEQ,),
    heavy: HeavyKeys | None = None,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Companies with their last employee count, 0 where there is none."""
    wanted = ("company_id", "employee_count")
    if employee_counts is None or not set(wanted) <= set(employee_counts.columns):
        return companies.withColumn("employee_count", F.lit(0).cast("bigint"))
    last = dedupe(employee_counts.select(*wanted, *order_by), ["company_id"], order_by, "last").select(*wanted)
    joined = left_join_default(companies, last, ["company_id"], heavy=heavy, salt_by=salt_by)
    return joined.withColumn("employee_count", cast_numeric_coerce("employee_count"))


def company_industry_join(
    companies: DataFrame,
    industries: DataFrame | None,
    order_by: Sequence[str] = (SEQ,),
    heavy: HeavyKeys | None = None,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Companies with their first industry, `Unknown` where there is none."""
    if industries is not None:
        industries = resolve_column(industries, ["industry_name", "industry"], "industry")
        require_columns(industries, ["company_id"])
    if industries is None or "industry" not in industries.columns:
        return companies.withColumn("industry", F.lit(UNKNOWN))
    wanted = ("company_id", "industry")
    first = dedupe(industries.select(*wanted, *order_by), ["company_id"], order_by, "first").select(*wanted)
    return left_join_default(
        companies, first, ["company_id"], {"industry": UNKNOWN}, heavy=heavy, salt_by=salt_by
    )


def dim_company(
    companies: DataFrame,
    employee_counts: DataFrame | None = None,
    industries: DataFrame | None = None,
    counts_order: Sequence[str] = (SEQ,),
    industries_order: Sequence[str] = (SEQ,),
) -> DataFrame:
    """One row per company row; both joined tables are reduced to one row per company first."""
    require_columns(companies, ["company_id", "name"])
    base = company_employee_join(companies, employee_counts, counts_order)
    base = company_industry_join(base, industries, industries_order)
    dim = select_existing(base, DIM_COMPANY_COLUMNS).withColumn("company_key", prefix_key("company_id", "name"))
    as_text = [c for c in ("company_size", "industry", "country", "name") if c in dim.columns]
    return dim.withColumns({c: cast_string_nulltoken(c) for c in as_text})


def dim_location(dim_company: DataFrame) -> DataFrame:
    """One row per distinct place of a company. `location_key` is coarser than a row, so it repeats."""
    cols = [c for c in LOCATION_COLUMNS if c in dim_company.columns]
    if not cols:
        empty = ", ".join(f"{c} string" for c in ("location_key", *LOCATION_COLUMNS))
        return dim_company.sparkSession.createDataFrame([], empty)
    places = dim_company.select(*[cast_string_nulltoken(c).alias(c) for c in cols]).distinct()
    return places.withColumn("location_key", concat_key_fallback(places, ["country", "state"]))


def dim_time(jobs: DataFrame) -> DataFrame:
    """One row per listing day, made distinct as dates, each with a key that reads back as that date."""
    if "original_listed_time" not in jobs.columns:
        return jobs.sparkSession.createDataFrame([], DIM_TIME_SCHEMA)
    days = jobs.select(F.to_date("original_listed_time").alias("_day")).na.drop().distinct()
    return date_parts(days.select(format_date_key("_day").alias("time_key"), "_day"), "_day").drop("_day")


def fact_company_join(jobs: DataFrame, dim_company: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Jobs with the key and place of their company. A company id that repeats repeats its jobs."""
    lookup = select_existing(dim_company, ("company_id", "company_key", "location_key", *LOCATION_COLUMNS))
    return left_join_default(jobs, lookup, ["company_id"], heavy=heavy, salt_by=_salt_columns(jobs))


def fact_benefits_join(
    jobs: DataFrame, benefits: DataFrame | None, mode: str = "auto", heavy: HeavyKeys | None = None
) -> DataFrame:
    """Jobs with their number of benefits, 0 where there are none."""
    if benefits is None or "job_id" not in benefits.columns:
        return jobs.withColumn("benefits_count", F.lit(0).cast("bigint"))
    counts = benefits_count(benefits, mode=mode)
    return left_join_default(
        jobs, counts, ["job_id"], {"benefits_count": 0}, False, heavy, salt_by=_salt_columns(jobs)
    )


def fact_location_join(
    rows: DataFrame, dim_location: DataFrame, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Replace the place columns by `location_key`; rows without a company keep a null key.

    A null place column of a known company matches the text it has in the dimension.
    """
    cols = [c for c in LOCATION_COLUMNS if c in rows.columns and c in dim_location.columns]
    if not cols:
        return rows.withColumn("location_key", F.lit(None).cast("string"))
    if "company_key" in rows.columns:
        known = F.col("company_key").isNotNull()
        rows = rows.withColumns({c: F.when(known, cast_string_nulltoken(c)) for c in cols})
    joined = left_join_default(
        rows, dim_location.select(*cols, "location_key"), cols, null_safe=False, heavy=heavy
    )
    return joined.drop(*cols)


def fk_nullify(
    fact: DataFrame, fk: str, dim: DataFrame, key: str, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Null the foreign keys that the dimension does not have; Spark decides by size how to join."""
    known = dim.select(F.col(key).alias(fk)).distinct().withColumn("_known", F.lit(True))
    joined = left_join_default(fact, known, [fk], null_safe=False, heavy=heavy)
    return joined.withColumn(fk, F.when(F.col("_known"), F.col(fk))).select(*fact.columns)


def fact_salary_fallback(
    fact: DataFrame,
    salaries: DataFrame | None,
    order_by: Sequence[str] = (SEQ,),
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Add the salary columns that the fact lacks from the first salary row of each job."""
    lacking = [c for c in ("normalized_salary", "currency", "pay_period") if c not in fact.columns]
    if not lacking or salaries is None or not {"job_id", "normalized_salary"} <= set(salaries.columns):
        return fact
    lacking = [c for c in lacking if c in salaries.columns]
    needed = dict.fromkeys(["job_id", *lacking, *order_by])
    first = dedupe(salaries.select(*needed), ["job_id"], order_by, "first").select("job_id", *lacking)
    return left_join_default(fact, first, ["job_id"], heavy=heavy, salt_by=_salt_columns(fact))


def _salt_columns(jobs: DataFrame) -> list[str] | None:
    """The row number spreads even identical rows; without it the whole row is hashed."""
    return ["job_id_modify"] if "job_id_modify" in jobs.columns else None


def _normalize_salary(fact: DataFrame) -> DataFrame:
    if "normalized_salary" not in fact.columns:
        return fact
    salary = fill_constant(to_double("normalized_salary"), 0.0)
    if "currency" in fact.columns:
        salary = currency_to_usd(salary, fill_constant("currency", "USD"), guarded=True)
    if "pay_period" in fact.columns:
        salary = annualize_salary(salary, "pay_period", guarded=True)
    return fact.withColumns(
        {
            "normalized_salary": clip_upper_const(salary, FACT_SALARY_CAP),
            "currency": F.lit("USD"),
            "pay_period": F.lit("YEARLY"),
        }
    )


def fact_jobs(
    jobs: DataFrame,
    dim_company: DataFrame,
    dim_location: DataFrame,
    dim_time: DataFrame,
    benefits: DataFrame | None = None,
    salaries: DataFrame | None = None,
    salaries_order: Sequence[str] = (SEQ,),
    benefits_mode: str = "auto",
) -> DataFrame:
    """One row per job and company match.

    The place of a job is its company's, so the location key is attached to the companies,
    before they meet the far larger jobs. Only the company of a job can be a hot key here; jobs
    have an id each, and what is joined to them by it has one row per id.
    """
    require_columns(jobs, ["job_id", "company_id", "title"])
    jobs = select_existing(jobs, FACT_JOB_COLUMNS)
    heavy = heavy_keys(jobs, {"company": ["company_id"]})["company"]
    companies = select_existing(dim_company, ("company_id", "company_key", *LOCATION_COLUMNS))
    companies = fact_location_join(companies, dim_location)
    fact = fact_company_join(jobs, companies, heavy)
    fact = fact_benefits_join(fact, benefits, benefits_mode)
    if "original_listed_time" in fact.columns:
        fact = fact.withColumn("time_key", format_date_key("original_listed_time"))
        fact = fk_nullify(fact, "time_key", dim_time, "time_key")
    else:
        fact = fact.withColumn("time_key", F.lit(None).cast("string"))
    fact = _normalize_salary(fact_salary_fallback(fact, salaries, salaries_order))
    fact = select_existing(fact, FACT_COLUMNS)
    finals = {"views": cast_numeric_coerce, "remote_allowed": cast_bool_nonzero}
    return fact.withColumns({c: f(c) for c, f in finals.items() if c in fact.columns})


_PART_KEYS = ("company_key", "time_key")


def rollup_parts(fact: DataFrame) -> DataFrame:
    """What the rollup needs of some rows of the fact: jobs, views, salaries and paid jobs per company and day.

    These are counts and sums only, so the parts of several loads can be added up. Salaries are summed as
    decimals of six places, which makes the sum independent of the order of rows and loads; a salary
    beyond 10^22 counts as unknown.
    """
    paid = F.col("normalized_salary") != 0
    return fact.groupBy(*_PART_KEYS).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("views").alias("views"),
        F.sum(F.when(paid, F.col("normalized_salary").try_cast("decimal(28,6)"))).alias("salaries"),
        F.count_if(paid).alias("paid_jobs"),
    )


def add_parts(*parts: DataFrame) -> DataFrame:
    """The parts of all rows together, from those of disjoint rows."""
    sums = [F.sum(c).alias(c) for c in ("jobs", "views", "salaries", "paid_jobs")]
    added = reduce(DataFrame.unionByName, parts).groupBy(*_PART_KEYS).agg(*sums)
    return added.withColumn("salaries", F.col("salaries").cast("decimal(38,6)"))


def rollup_of_parts(parts: DataFrame, dim_company: DataFrame, dim_time: DataFrame) -> DataFrame:
    """The rollup from parts, by the dimensions as they are now."""
    order = ["industry", "country"]
    companies = dedupe(dim_company.select("company_key", *order), ["company_key"], order)
    days = dim_time.select("time_key", "year", "month")
    joined = left_join_default(parts, companies, ["company_key"], null_safe=False)
    joined = left_join_default(joined, days, ["time_key"], null_safe=False)
    paid_jobs = F.sum("paid_jobs")
    mean = F.sum("salaries").cast("double") / F.nullif(paid_jobs, F.lit(0))
    return joined.groupBy("year", "month", *order).agg(
        F.sum("jobs").alias("jobs"),
        F.sum("views").alias("views"),
        paid_jobs.alias("paid_jobs"),
        mean.alias("avg_salary"),
    )


def star_rollup(fact: DataFrame, dim_company: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Jobs, views and mean non-zero salary by year, month, industry and country.

    The fact is first reduced to one row per company and day, so the joins see no large group.
    """
    return rollup_of_parts(rollup_parts(fact), dim_company, dim_time)
