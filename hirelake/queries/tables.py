"""Queries on projections, filters, limits and unions."""

from pyspark.sql import functions as F

from hirelake.fixed_values import COMPANY_DEFAULTS, JOB_COLUMNS_DROPPED, SALARY_COLUMNS
from hirelake.functions.dates import date_parts, parse_date_key
from hirelake.operators import projection
from hirelake.queries.registry import query
from hirelake.queries.scalars import _date_texts


@query("SELECT job_id, title, normalized_salary AS normalized_salary, pay_period FROM v_jobs")
def normalize_columns(v):
    messy = {"job_id": ' "Job ID" ', "title": "Title", "normalized_salary": "Normalized Salary", "pay_period": '"PAY_period"'}
    return projection.normalize_columns(v.jobs.select(*messy).withColumnsRenamed(messy))


@query("""SELECT job_id, company_id, title, views, remote_allowed, original_listed_time, normalized_salary,
 pay_period, currency, zip_code, formatted_experience_level FROM v_jobs""")
def drop_columns_if_exist(v):
    return projection.drop_columns_if_exist(v.jobs, (*JOB_COLUMNS_DROPPED, *SALARY_COLUMNS, "inferred"))


@query("SELECT title, job_id, views, normalized_salary FROM v_jobs")
def select_existing(v):
    return projection.select_existing(v.jobs, ("title", "job_id", "no_such_column", "views", "normalized_salary"))


@query("SELECT _seq, company_id, industry AS industry_name, industry FROM v_industries")
def resolve_column(v):
    renamed = v.industries.withColumnRenamed("industry", "industry_name")
    return projection.resolve_column(renamed, ["industry_name", "industry"], "industry")


@query("SELECT job_id, 'USD' AS currency, 'YEARLY' AS pay_period, 0 AS benefits_count FROM v_jobs")
def constant_column(v):
    jobs = v.jobs.select("job_id", "currency", "pay_period")
    for name, value in {"currency": "USD", "pay_period": "YEARLY", "benefits_count": 0}.items():
        jobs = projection.constant_column(jobs, name, value)
    return jobs


@query("""SELECT company_id, coalesce(zip_code, 'Unknown') AS zip_code, coalesce(state, 'Unknown') AS state,
 coalesce(city, 'Unknown') AS city, coalesce(description, 'No description') AS description,
 coalesce(address, 'No specific address') AS address FROM v_companies""")
def fill_per_column(v):
    return projection.fill_per_column(v.companies.select("company_id", *COMPANY_DEFAULTS), COMPANY_DEFAULTS)


@query("SELECT company_id, name, state FROM v_companies WHERE name IS NOT NULL")
def drop_null_rows(v):
    return projection.drop_null_rows(v.companies.select("company_id", "name", "state"), ["name"])


@query("""SELECT job_id, strftime(listed, '%Y%m%d') AS time_key, CAST(year(listed) AS INTEGER) AS year,
 CAST(month(listed) AS INTEGER) AS month, CAST(day(listed) AS INTEGER) AS day
 FROM (SELECT job_id, make_timestamp(CAST(original_listed_time AS BIGINT) * 1000) AS listed FROM v_jobs
  WHERE original_listed_time IS NOT NULL AND job_id % 7 <> 0)""")
def filter_valid_dates(v):
    valid = projection.filter_valid_dates(_date_texts(v), "time_key")
    return date_parts(valid.withColumn("listed", parse_date_key("time_key")), "listed").drop("listed")


@query("""SELECT job_id, currency, currency IS NULL AS is_null, currency IS NOT NULL AS is_not_null,
 coalesce(currency NOT IN ('USD', 'EUR'), true) AS not_in FROM v_jobs""")
def is_null_predicates(v):
    return projection.is_null_predicates(v.jobs.select("job_id", "currency"), "currency", ("USD", "EUR"))


@query("SELECT job_id, views, normalized_salary, zip_code FROM v_jobs")
def nan_to_null(v):
    columns = ("views", "normalized_salary", "zip_code")
    with_nan = {c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns}
    return projection.nan_to_null(v.jobs.select("job_id", *columns).withColumns(with_nan))


@query("SELECT job_id, title, normalized_salary FROM v_jobs ORDER BY job_id LIMIT 5")
def preview(v):
    return projection.preview(v.jobs.select("job_id", "title", "normalized_salary"), order_by=["job_id"])


@query("""SELECT job_id, normalized_salary FROM v_jobs ORDER BY normalized_salary DESC NULLS LAST, job_id LIMIT 10""")
def limit_n(v):
    order = [F.col("normalized_salary").desc_nulls_last(), "job_id"]
    return projection.limit_n(v.jobs.select("job_id", "normalized_salary"), 10, order)


@query("SELECT job_id, currency, normalized_salary FROM v_jobs")
def union_chunks(v):
    jobs = v.jobs.select("job_id", "currency", "normalized_salary")
    chunks = [
        jobs.filter(F.col("currency").isNull()),
        jobs.filter("currency = 'USD'").select("currency", "job_id", "normalized_salary"),
        jobs.filter("currency <> 'USD'"),
    ]
    return projection.union_chunks(chunks)
