"""Queries on the joins, the cleaned tables, the star schema and the whole load."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hirelake.fixed_values import MODEL_TABLES
from hirelake.functions.dates import format_date_key
from hirelake.operators import skew
from hirelake.plans import cleaning, load, star
from hirelake.queries.bindings import BENEFITS_ORDER, CLEANED_SALARIES_ORDER, Views
from hirelake.queries.oracle import REPAIRED_JOB, UNIFIED, capped
from hirelake.queries.registry import query
from hirelake.queries.stored import fresh_layer
from hirelake.session import fresh_path
from hirelake.sources import layers
from hirelake.sources.staging import stage


def _jobs(v: Views):
    return cleaning.clean_jobs(v.jobs, ["job_id"])


def _companies(v: Views):
    return cleaning.clean_companies(v.companies)


def _benefits(v: Views):
    return cleaning.clean_benefits(v.benefits, BENEFITS_ORDER)


def _listed(v: Views):
    return cleaning.listing_times(v.jobs.select("job_id", "original_listed_time"))


def _dim_company(v: Views):
    return star.dim_company(_companies(v), v.employee_counts, cleaning.clean_industries(v.industries))


def _star(v: Views):
    """The fact and its dimensions, from the tables as they are: benefits are counted, not listed."""
    jobs, company = cleaning.clean_job_values(v.jobs), _dim_company(v)
    location, time = star.dim_location(company), star.dim_time(_listed(v))
    return star.fact_jobs(jobs, company, location, time, v.benefits, benefits_mode="rows"), company, time


# Joins


@query("""SELECT c.company_id, coalesce(employee_count, 0) AS employee_count
 FROM v_companies c LEFT JOIN last_count e ON c.company_id = e.company_id""")
def company_employee_join(v):
    companies = v.companies.select("company_id")
    heavy = skew.heavy_keys(companies, {"company": ["company_id"]})["company"]
    return star.company_employee_join(companies, v.employee_counts, heavy=heavy)


@query("""SELECT c.company_id, coalesce(industry, 'Unknown') AS industry
 FROM v_companies c LEFT JOIN first_industry i ON c.company_id = i.company_id""")
def company_industry_join(v):
    companies = v.companies.select("company_id")
    heavy = skew.heavy_keys(companies, {"company": ["company_id"]})["company"]
    return star.company_industry_join(companies, cleaning.clean_industries(v.industries), heavy=heavy)


@query("""SELECT job_id, coalesce(CAST(j.company_id AS BIGINT), -1) AS company_id, d.company_key, d.city, d.state,
 d.zip_code, d.country FROM v_jobs j LEFT JOIN d_company d ON j.company_id = d.company_id""")
def fact_company_join(v):
    jobs = v.jobs.select("job_id", F.coalesce(F.col("company_id").cast("bigint"), F.lit(-1)).alias("company_id"))
    heavy = skew.heavy_keys(jobs, {"company": ["company_id"]})["company"]
    return star.fact_company_join(jobs, _dim_company(v), heavy)


@query("""SELECT job_id, coalesce(items, 0) AS benefits_count FROM v_jobs LEFT JOIN c_benefits USING (job_id)""")
def fact_benefits_join(v):
    return star.fact_benefits_join(v.jobs.select("job_id"), v.benefits, mode="rows")


@query("""SELECT job_id, company_key, d.country || d.state AS location_key
 FROM v_jobs j LEFT JOIN d_company d ON j.company_id = d.company_id""")
def fact_location_join(v):
    company = stage(_dim_company(v), "dim_company")
    jobs = v.jobs.select("job_id", F.coalesce(F.col("company_id").cast("bigint"), F.lit(-1)).alias("company_id"))
    heavy = skew.heavy_keys(jobs, {"company": ["company_id"]})["company"]
    rows = star.fact_company_join(jobs, company, heavy).drop("company_id")
    places = skew.heavy_keys(rows, {"place": ["city", "state", "zip_code", "country"]})["place"]
    return star.fact_location_join(rows, star.dim_location(company), places)


@query("""SELECT job_id, title, normalized_salary, currency, pay_period
 FROM v_jobs_only LEFT JOIN first_salary USING (job_id)""".replace("v_jobs_only", "(SELECT job_id, title FROM v_jobs)"))
def fact_salary_fallback(v):
    jobs = v.jobs.select("job_id", "title")
    heavy = skew.heavy_keys(jobs, {"job": ["job_id"]})["job"]
    return star.fact_salary_fallback(jobs, cleaning.clean_salaries(v.salaries), CLEANED_SALARIES_ORDER, heavy)


@query("""SELECT job_id, CASE WHEN day(original_listed_time) <= 20 THEN strftime(original_listed_time, '%Y%m%d') END
 AS time_key FROM c_jobs""")
def fk_nullify(v):
    jobs = _listed(v)
    keyed = jobs.select("job_id", format_date_key("original_listed_time").alias("time_key"))
    early = star.dim_time(jobs).filter("day <= 20")
    return star.fk_nullify(keyed, "time_key", early, "time_key")


# Cleaned tables


@query("SELECT * FROM c_jobs")
def clean_jobs(v):
    return _jobs(v)


@query("SELECT * FROM c_salaries")
def clean_salaries(v):
    return cleaning.clean_salaries(v.salaries)


@query("SELECT job_id, type, _part FROM c_benefits")
def clean_benefits(v):
    return _benefits(v).withColumn("type", F.array_join("type", "|", "NULL"))


@query("SELECT * FROM c_employee_counts")
def clean_employee_counts(v):
    return cleaning.clean_employee_counts(v.employee_counts)


@query("SELECT * FROM c_industries")
def clean_industries(v):
    return cleaning.clean_industries(v.industries)


@query("SELECT * FROM c_companies")
def clean_companies(v):
    return _companies(v)


@query(f"""SELECT {REPAIRED_JOB}, {capped('normalized_salary', 'v_jobs')} AS normalized_salary,
 coalesce(pay_period, 'Unknown') AS pay_period, coalesce(currency, 'Unknown') AS currency FROM v_jobs""")
def clean_jobs_notebook(v):
    return cleaning.clean_jobs_notebook(v.jobs, ["job_id"])


_RAW_SALARY = f"(SELECT {UNIFIED} AS raw_salary FROM v_salaries)"


@query(f"""SELECT job_id, l_linenumber, l_partkey, l_suppkey, pay_period, currency,
 {capped('max_salary', 'v_salaries')} AS max_salary, {capped('med_salary', 'v_salaries')} AS med_salary,
 {capped('min_salary', 'v_salaries')} AS min_salary, {capped('raw_salary', _RAW_SALARY)} AS raw_salary
 FROM (SELECT *, {UNIFIED} AS raw_salary FROM v_salaries)""")
def clean_salaries_notebook(v):
    return cleaning.clean_salaries_notebook(v.salaries)


# Star schema


@query("SELECT * FROM d_company")
def dim_company(v):
    return _dim_company(v)


@query("SELECT * FROM d_location")
def dim_location(v):
    return star.dim_location(_dim_company(v))


@query("SELECT * FROM d_time")
def dim_time(v):
    return star.dim_time(_listed(v))


@query("SELECT * FROM f_jobs")
def fact_jobs(v):
    return _star(v)[0]


_ROLLUP = """SELECT t.year, t.month, d.industry, d.country, count(*) AS jobs, CAST(sum(f.views) AS BIGINT) AS views,
 count(*) FILTER (normalized_salary <> 0) AS paid_jobs,
 CAST(sum(CAST(normalized_salary AS DECIMAL(28, 6))) FILTER (normalized_salary <> 0) AS DOUBLE)
  / nullif(count(*) FILTER (normalized_salary <> 0), 0) AS avg_salary
 FROM f_jobs f LEFT JOIN d_company d ON f.company_key = d.company_key LEFT JOIN d_time t ON f.time_key = t.time_key
 GROUP BY ALL"""


@query(_ROLLUP)
def star_rollup(v):
    return star.star_rollup(*_star(v))


@query(_ROLLUP)
def star_rollup_added(v):
    """The same from stored parts of the fact's rows, added up one load after another."""
    fact, company, time = _star(v)
    layer = fresh_layer(v, "model")
    for third in range(3):
        parts = star.rollup_parts(fact.filter(F.pmod(F.xxhash64("job_id"), F.lit(3)) == third))
        if third:
            parts = star.add_parts(layers.scan_table(v.spark, layer, "rollup_parts"), parts)
        layers.replace_table(parts, layer, "rollup_parts")
    return star.rollup_of_parts(layers.scan_table(v.spark, layer, "rollup_parts"), company, time)


# Every column of the four star tables, put into rows of one shape.
_CONTENTS = """SELECT 'fact_jobs' AS table_name, job_id AS id, company_key AS key_1, location_key AS key_2,
 time_key AS key_3, title || '|' || currency || '|' || pay_period AS label, CAST(views AS DOUBLE) AS number_1,
 CAST(benefits_count AS DOUBLE) AS number_2, normalized_salary AS number_3, remote_allowed AS flag FROM {fact_jobs}
UNION ALL SELECT 'dim_company', company_id, company_key, country, state,
 name || '|' || company_size || '|' || industry || '|' || city || '|' || zip_code, CAST(employee_count AS DOUBLE),
 NULL, NULL, NULL FROM {dim_company}
UNION ALL SELECT 'dim_location', NULL, location_key, country, state, city || '|' || zip_code, NULL, NULL, NULL, NULL
 FROM {dim_location}
UNION ALL SELECT 'dim_time', NULL, time_key, NULL, NULL, NULL, CAST(year AS DOUBLE), CAST(month AS DOUBLE),
 CAST(day AS DOUBLE), NULL FROM {dim_time}
UNION ALL SELECT table_name, row_count, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {counts}"""
_COUNTS = " UNION ALL ".join(
    f"SELECT 'rows of {table}' AS table_name, count(*) AS row_count FROM {part}"
    for table, part in {
        "dim_company": "d_company", "dim_location": "d_location", "dim_time": "d_time", "fact_jobs": "f_jobs",
        "jobs": "c_jobs", "salaries": "c_salaries", "benefits": "c_benefits", "companies": "c_companies",
        "employee_counts": "c_employee_counts", "industries": "c_industries",
    }.items()
)


@query(
    _CONTENTS.format(
        fact_jobs="f_jobs", dim_company="d_company", dim_location="d_location", dim_time="d_time", counts=f"({_COUNTS})"
    )
)
def run_pipeline(v):
    """The whole load from CSV files, in layers of its own: the stored star schema and the counts of its manifest."""
    warehouse = fresh_path(v.spark, "warehouse")
    raw = {name: df.drop("_seq") for name, df in v.raw().items()}
    paths = layers.write_csv_backup(raw, f"{warehouse}/source")
    names = load.Layers.with_suffix(uuid.uuid4().hex[:12])
    manifest = load.run_pipeline(v.spark, paths, warehouse, "run_1", names=names)
    tables = {t: layers.scan_table(v.spark, names.model, t) for t in MODEL_TABLES}
    label = F.concat(F.lit("rows of "), "table_name").alias("table_name")
    return v.spark.sql(_CONTENTS, **tables, counts=manifest.select(label, "row_count"))
