"""Queries on aggregates, profiles, dedupe and numbering."""

from pyspark.sql import functions as F

from hirelake.functions.dates import epoch_ms_to_ts
from hirelake.functions.money import annualize_salary, currency_to_usd
from hirelake.operators import ordering, profile, quantiles
from hirelake.queries.bindings import BENEFITS_ORDER, SALARIES_ORDER
from hirelake.queries.oracle import LISTED, capped, quantile, sorted_list
from hirelake.queries.registry import query


@query(f"""SELECT 0.25e0 AS q, {quantile('l', 0.25)} AS value FROM (SELECT {sorted_list('normalized_salary')} AS l FROM v_jobs)
UNION ALL SELECT 0.75e0, {quantile('l', 0.75)} FROM (SELECT {sorted_list('normalized_salary')} AS l FROM v_jobs)""")
def quantiles_exact(v):
    return quantiles.quantiles_exact(v.jobs, "normalized_salary")


@query(f"SELECT job_id, {capped('yearly', 'p_jobs')} AS yearly FROM p_jobs")
def iqr_cap(v):
    usd = currency_to_usd("normalized_salary", "currency")
    jobs = v.jobs.select("job_id", annualize_salary(usd, "pay_period").alias("yearly"))
    return quantiles.iqr_cap(jobs, ["yearly"])


@query("""SELECT 'normalized_salary' AS column_name, count(normalized_salary) = 0 AS all_null,
 count(normalized_salary) AS "values" FROM v_jobs
UNION ALL SELECT 'closed_time', count(closed_time) = 0, count(closed_time) FROM v_jobs""")
def all_null_check(v):
    checks = [
        quantiles.all_null_check(v.jobs, c).select(F.lit(c).alias("column_name"), "all_null", "values")
        for c in ("normalized_salary", "closed_time")
    ]
    return checks[0].unionByName(checks[1])


@query("SELECT company_id, company_size FROM (SELECT company_id, CAST(trunc(coalesce(company_size, "
       f"(SELECT {quantile('l', 0.5)} FROM (SELECT {sorted_list('company_size')} AS l FROM v_companies)))) AS BIGINT) "
       "AS company_size FROM v_companies)")
def median_impute(v):
    return quantiles.median_impute(v.companies.select("company_id", "company_size"), "company_size")


@query("SELECT job_id, type, _part FROM c_benefits")
def collect_list_by_key(v):
    lists = ordering.collect_list_by_key(v.benefits, "job_id", "type", BENEFITS_ORDER)
    return lists.withColumn("type", F.array_join("type", "|", "NULL"))


@query("SELECT job_id, count(*) AS benefits_count FROM v_benefits GROUP BY job_id")
def array_length(v):
    lists = ordering.collect_list_by_key(v.benefits, "job_id", "type", BENEFITS_ORDER)
    return profile.benefits_count(lists, mode="length")


@query("""SELECT job_id, 'list' AS kind, count(*) AS benefits_count FROM v_benefits GROUP BY job_id
UNION ALL SELECT DISTINCT job_id, 'text', 1 FROM v_benefits""")
def array_type_branch(v):
    lists = ordering.collect_list_by_key(v.benefits, "job_id", "type", BENEFITS_ORDER)
    counted = [
        profile.benefits_count(df).select("job_id", F.lit(kind).alias("kind"), "benefits_count")
        for kind, df in (("list", lists), ("text", v.benefits))
    ]
    return counted[0].unionByName(counted[1])


@query("SELECT DISTINCT job_id, CAST(1 AS BIGINT) AS benefits_count FROM v_benefits")
def benefit_presence(v):
    return profile.benefits_count(v.benefits, mode="presence")


@query("SELECT DISTINCT city, state, zip_code, country FROM v_companies")
def distinct_rows(v):
    return profile.distinct_rows(v.companies, ["city", "state", "zip_code", "country"])


@query("SELECT company_id, count(*) AS group_rows FROM v_jobs WHERE company_id IS NOT NULL GROUP BY company_id")
def group_size(v):
    return profile.group_size(v.jobs, ["company_id"])


# Columns of the views with their type as Spark names it.
VIEW_TYPES = {
    "v_jobs": {
        "job_id": "bigint", "company_id": "double", "title": "string", "views": "double",
        "remote_allowed": "double", "original_listed_time": "double", "normalized_salary": "double",
        "pay_period": "string", "currency": "string", "zip_code": "double",
        "formatted_experience_level": "string", "applies": "double", "closed_time": "double",
        "compensation_type": "string",
    },
    "v_companies": {
        "company_id": "bigint", "name": "string", "company_size": "double", "country": "string",
        "state": "string", "city": "string", "zip_code": "string", "description": "string", "address": "string",
    },
    "v_employee_counts": {
        "company_id": "bigint", "employee_count": "bigint", "follower_count": "bigint",
        "time_recorded": "bigint", "_seq": "bigint",
    },
    "v_industries": {"company_id": "bigint", "industry": "string", "_seq": "bigint"},
    "v_benefits": {
        "job_id": "bigint", "type": "string", "inferred": "int", "l_linenumber": "int",
        "l_partkey": "bigint", "l_suppkey": "bigint", "l_extendedprice": "double",
    },
    "v_salaries": {
        "job_id": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint",
        "med_salary": "double", "min_salary": "double", "max_salary": "double", "pay_period": "string",
        "currency": "string",
    },
    "v_skills_industries": {"skill_abr": "string", "skill_name": "string"},
}
FIGURES = ("mean", "std", "min", "q25", "median", "q75", "max")
# Means of millisecond times are sums beyond the exact range of a double.
COARSE = ("original_listed_time",)


def _figures_sql(view: str, col: str) -> str:
    if VIEW_TYPES[view][col] == "string":
        return ", ".join(f"CAST(NULL AS DOUBLE) AS {f}" for f in FIGURES)
    mean = 0 if col in COARSE else 4
    parts = {
        "mean": f"round(avg({col}), {mean})",
        "std": f"round(stddev_samp({col}), 2)" if col not in COARSE else f"round(stddev_samp({col}), 0)",
        "min": f"min({col})",
        "q25": quantile(sorted_list(col), 0.25),
        "median": quantile(sorted_list(col), 0.5),
        "q75": quantile(sorted_list(col), 0.75),
        "max": f"max({col})",
    }
    return ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in parts.items())


def _rounded(df):
    coarse = F.col("column_name").isin(*COARSE)
    return df.withColumns(
        {
            "mean": F.when(coarse, F.round("mean", 0)).otherwise(F.round("mean", 4)),
            "std": F.when(coarse, F.round("std", 0)).otherwise(F.round("std", 2)),
        }
    )


def _numeric(view: str) -> list[str]:
    return [c for c, t in VIEW_TYPES[view].items() if t != "string"]


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS \"values\", {_figures_sql('v_jobs', c)} FROM v_jobs"
    for c in _numeric("v_jobs")
))
def describe(v):
    return _rounded(profile.describe(v.jobs))


@query("\nUNION ALL ".join(
    f"SELECT '{view}' AS table_name, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, "
    f"count(*) - count({c}) AS nulls, {_figures_sql(view, c)} FROM {view}"
    for view, types in VIEW_TYPES.items() for c, t in types.items()
))
def profile_tables(v):
    return _rounded(profile.profile_tables({f"v_{name}": df for name, df in v.raw().items()}))


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM v_jobs" for c in VIEW_TYPES["v_jobs"]
))
def null_counts(v):
    return profile.null_counts(v.jobs)


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS row_count FROM v_companies"
    for c, t in VIEW_TYPES["v_companies"].items()
))
def table_info(v):
    return profile.table_info(v.companies)


@query("SELECT count(DISTINCT company_id) AS distinct_values FROM v_jobs")
def count_distinct(v):
    return profile.count_distinct(v.jobs, "company_id")


@query("SELECT count(*) AS row_count FROM v_salaries")
def row_count(v):
    return profile.row_count(v.salaries)


@query(f"SELECT {LISTED} AS listed, count(*) AS row_count FROM v_jobs WHERE original_listed_time IS NOT NULL GROUP BY 1")
def value_counts_sorted(v):
    listed = v.jobs.select(epoch_ms_to_ts("original_listed_time").alias("listed"))
    return profile.value_counts_sorted(listed, "listed")


@query("SELECT views, count(*) AS row_count FROM v_jobs WHERE views IS NOT NULL GROUP BY views ORDER BY views")
def order_by_value(v):
    return profile.value_counts_sorted(v.jobs, "views")


@query("""SELECT * FROM v_employee_counts
 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY _seq DESC) = 1""")
def dedupe_keep_last(v):
    return ordering.dedupe(v.employee_counts, ["company_id"], ["_seq"], "last")


@query("""SELECT * FROM v_salaries QUALIFY row_number() OVER (PARTITION BY job_id
 ORDER BY l_linenumber, l_partkey, l_suppkey, med_salary NULLS FIRST, min_salary NULLS FIRST, max_salary NULLS FIRST) = 1""")
def dedupe_keep_first(v):
    return ordering.dedupe(v.salaries, ["job_id"], SALARIES_ORDER, "first")


@query("""SELECT job_id, title, row_number() OVER (ORDER BY job_id) AS job_id_modify,
 row_number() OVER (ORDER BY job_id) AS company_id_modify FROM v_jobs""")
def sequential_id(v):
    names = ("job_id_modify", "company_id_modify")
    return ordering.sequential_id(v.jobs.select("job_id", "title"), ["job_id"], names)
