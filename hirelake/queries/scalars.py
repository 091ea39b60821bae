"""Queries on the column functions: nulls, casts, text, dates, money."""

from pyspark.sql import functions as F

from hirelake.functions import dates, money, values
from hirelake.queries.oracle import CLEANING_RATE, LISTED, MODEL_RATE, UNIFIED, YEARLY_FACTOR
from hirelake.queries.registry import query


@query("""SELECT job_id, coalesce(company_id, -1e0) AS company_id, coalesce(views, 0e0) AS views,
 coalesce(remote_allowed, 0e0) AS remote_allowed, coalesce(currency, 'USD') AS currency,
 coalesce(pay_period, 'YEARLY') AS pay_period FROM v_jobs""")
def fill_constant(v):
    fills = {"company_id": -1.0, "views": 0.0, "remote_allowed": 0.0, "currency": "USD", "pay_period": "YEARLY"}
    return v.jobs.select("job_id", *[values.fill_constant(c, x).alias(c) for c, x in fills.items()])


@query("""SELECT job_id, coalesce(formatted_experience_level, 'No specified') AS level,
 CASE WHEN token = 'nan' OR token IS NULL THEN 'No specified' ELSE token END AS token
 FROM (SELECT *, CASE WHEN job_id % 4 = 1 THEN 'nan' ELSE formatted_experience_level END AS token FROM v_jobs)""")
def replace_missing_token(v):
    token = F.when(F.col("job_id") % 4 == 1, "nan").otherwise(F.col("formatted_experience_level"))
    return v.jobs.select(
        "job_id",
        values.replace_missing_token("formatted_experience_level").alias("level"),
        values.replace_missing_token(token).alias("token"),
    )


@query("""SELECT job_id, CAST(zip_code AS VARCHAR) AS zip_code,
 CAST(zip_code * 1000 AS VARCHAR) AS long_zip_code FROM v_jobs""")
def zip_to_string(v):
    return v.jobs.select(
        "job_id",
        values.zip_to_string("zip_code").alias("zip_code"),
        values.zip_to_string(F.col("zip_code") * 1000).alias("long_zip_code"),
    )


@query("""SELECT job_id, coalesce(currency, 'Unknown') AS currency, coalesce(pay_period, 'Unknown') AS pay_period
 FROM v_jobs""")
def replace_null_with_unknown(v):
    return v.jobs.select(
        "job_id", *[values.replace_null_with_unknown(c).alias(c) for c in ("currency", "pay_period")]
    )


@query("""SELECT company_id, CASE WHEN state = '0' THEN 'Unknown' ELSE state END AS state,
 CASE WHEN zip_code = '0' THEN 'Unknown' ELSE zip_code END AS zip_code FROM v_companies""")
def replace_exact_value(v):
    return v.companies.select(
        "company_id", *[values.replace_exact_value(c, "0", "Unknown").alias(c) for c in ("state", "zip_code")]
    )


@query("""SELECT job_id, CAST(coalesce(views, 0) AS BIGINT) AS views,
 CASE WHEN job_id % 3 = 0 THEN 0 WHEN job_id % 3 = 1 THEN CAST(floor(normalized_salary) AS BIGINT)
  ELSE CAST(job_id AS BIGINT) END AS salary
 FROM (SELECT job_id, views, coalesce(normalized_salary, 0) AS normalized_salary FROM v_jobs)""")
def cast_numeric_coerce(v):
    text = (
        F.when(F.col("job_id") % 3 == 0, "abc")
        .when(F.col("job_id") % 3 == 1, F.col("normalized_salary").cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("job_id").cast("string"), F.lit(".7 ")))
    )
    return v.jobs.select(
        "job_id",
        values.cast_numeric_coerce("views").alias("views"),
        values.cast_numeric_coerce(text).alias("salary"),
    )


@query("""SELECT job_id, CAST(trunc(normalized_salary) AS BIGINT) AS salary, CAST(views AS BIGINT) AS views
 FROM v_jobs""")
def cast_int_trunc(v):
    return v.jobs.select(
        "job_id",
        values.cast_int_trunc("normalized_salary").alias("salary"),
        values.cast_int_trunc("views").alias("views"),
    )


@query("""SELECT job_id, coalesce(remote_allowed, 0) <> 0 AS remote_allowed, coalesce(views, 0) <> 0 AS viewed
 FROM v_jobs""")
def cast_bool_nonzero(v):
    return v.jobs.select(
        "job_id",
        values.cast_bool_nonzero("remote_allowed").alias("remote_allowed"),
        values.cast_bool_nonzero("views").alias("viewed"),
    )


@query("""SELECT company_id, coalesce(country, 'None') AS country, coalesce(name, 'None') AS name,
 coalesce(CAST(company_size AS VARCHAR), 'nan') AS company_size FROM v_companies""")
def cast_string_nulltoken(v):
    return v.companies.select(
        "company_id",
        values.cast_string_nulltoken("country").alias("country"),
        values.cast_string_nulltoken("name").alias("name"),
        values.cast_string_nulltoken("company_size", "nan").alias("company_size"),
    )


@query("SELECT job_id, upper(pay_period) AS pay_period FROM v_jobs")
def upper_case(v):
    return v.jobs.select("job_id", values.upper_case("pay_period").alias("pay_period"))


@query("""SELECT company_id, company_id || '_' || substr(coalesce(name, 'None'), 1, 3) AS company_key
 FROM v_companies""")
def prefix_key(v):
    return v.companies.select("company_id", values.prefix_key("company_id", "name").alias("company_key"))


@query("""SELECT company_id, coalesce(country, 'None') || coalesce(state, 'None') AS both_columns,
 coalesce(country, 'None') AS country_only, 'UNK' AS neither FROM v_companies""")
def concat_key_fallback(v):
    places = v.companies.withColumns({c: values.cast_string_nulltoken(c) for c in ("country", "state")})
    key = ["country", "state"]
    return places.select(
        "company_id",
        values.concat_key_fallback(places, key).alias("both_columns"),
        values.concat_key_fallback(places.drop("state"), key).alias("country_only"),
        values.concat_key_fallback(places.drop(*key), key).alias("neither"),
    )


@query(f"SELECT job_id, {LISTED} AS listed FROM v_jobs")
def epoch_ms_to_ts(v):
    return v.jobs.select("job_id", dates.epoch_ms_to_ts("original_listed_time").alias("listed"))


@query(f"""SELECT job_id, CASE WHEN job_id % 3 = 0 THEN {LISTED} WHEN job_id % 3 = 1
 THEN CAST(CAST({LISTED} AS DATE) AS TIMESTAMP) ELSE NULL END AS listed FROM v_jobs""")
def epoch_fallback_parse(v):
    ms = F.col("original_listed_time")
    text = (
        F.when(F.col("job_id") % 3 == 0, ms.cast("bigint").cast("string"))
        .when(F.col("job_id") % 3 == 1, F.date_format(dates.epoch_ms_to_ts(ms), "yyyy-MM-dd"))
        .otherwise("no date")
    )
    return v.jobs.select("job_id", dates.epoch_fallback_parse(text).alias("listed"))


@query("""SELECT _seq, company_id, CAST(make_timestamp(time_recorded * 1000000) AS DATE) AS recorded
 FROM v_employee_counts""")
def epoch_s_to_date(v):
    return v.employee_counts.select("_seq", "company_id", dates.epoch_s_to_date("time_recorded").alias("recorded"))


@query(f"SELECT job_id, strftime({LISTED}, '%Y%m%d') AS time_key FROM v_jobs")
def format_date_key(v):
    listed = dates.epoch_ms_to_ts("original_listed_time")
    return v.jobs.select("job_id", dates.format_date_key(listed).alias("time_key"))


def _date_texts(v):
    """Date keys of the listing times; every seventh job has a day that does not exist."""
    key = dates.format_date_key(dates.epoch_ms_to_ts("original_listed_time"))
    broken = F.concat(F.substring(key, 1, 6), F.lit("39"))
    return v.jobs.select("job_id", F.when(F.col("job_id") % 7 == 0, broken).otherwise(key).alias("time_key"))


@query(f"""SELECT job_id, CASE WHEN job_id % 7 <> 0 THEN CAST({LISTED} AS DATE) END AS listed_day FROM v_jobs""")
def parse_date_key(v):
    return _date_texts(v).select("job_id", dates.parse_date_key("time_key").alias("listed_day"))


@query(f"""SELECT job_id, CAST(year({LISTED}) AS INTEGER) AS year, CAST(month({LISTED}) AS INTEGER) AS month,
 CAST(day({LISTED}) AS INTEGER) AS day FROM v_jobs""")
def date_parts(v):
    jobs = v.jobs.select("job_id", dates.epoch_ms_to_ts("original_listed_time").alias("listed"))
    return dates.date_parts(jobs, "listed").drop("listed")


@query(f"SELECT job_id, normalized_salary * {CLEANING_RATE} AS salary FROM v_jobs")
def currency_to_usd(v):
    return v.jobs.select("job_id", money.currency_to_usd("normalized_salary", "currency").alias("salary"))


@query(f"SELECT job_id, normalized_salary * {YEARLY_FACTOR} AS salary FROM v_jobs")
def annualize_salary(v):
    return v.jobs.select("job_id", money.annualize_salary("normalized_salary", "pay_period").alias("salary"))


@query(f"""SELECT job_id, CASE WHEN currency <> 'USD' AND signed > 0 THEN signed * {MODEL_RATE} ELSE signed END AS salary
 FROM (SELECT *, CASE WHEN job_id % 5 = 0 THEN -normalized_salary ELSE normalized_salary END AS signed FROM v_jobs)""")
def currency_to_usd_guarded(v):
    salary = F.col("normalized_salary")
    signed = F.when(F.col("job_id") % 5 == 0, -salary).otherwise(salary)
    return v.jobs.select("job_id", money.currency_to_usd(signed, "currency", guarded=True).alias("salary"))


@query(f"""SELECT job_id,
 CASE WHEN upper(coalesce(pay_period, 'YEARLY')) <> 'YEARLY' AND signed > 0 THEN signed * {YEARLY_FACTOR}
  ELSE signed END AS salary
 FROM (SELECT *, CASE WHEN job_id % 5 = 0 THEN -normalized_salary ELSE normalized_salary END AS signed FROM v_jobs)""")
def annualize_salary_guarded(v):
    salary = F.col("normalized_salary")
    signed = F.when(F.col("job_id") % 5 == 0, -salary).otherwise(salary)
    return v.jobs.select("job_id", money.annualize_salary(signed, "pay_period", guarded=True).alias("salary"))


_SALARY_ROW = ("job_id", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"SELECT job_id, l_linenumber, l_partkey, l_suppkey, {UNIFIED} AS salary FROM v_salaries")
def unify_salary(v):
    return v.salaries.select(
        *_SALARY_ROW, money.unify_salary("med_salary", "min_salary", "max_salary").alias("salary")
    )


@query("""SELECT job_id, CASE WHEN normalized_salary > 124000 THEN 124000e0 ELSE normalized_salary END AS salary
 FROM v_jobs""")
def clip_upper_const(v):
    return v.jobs.select("job_id", money.clip_upper_const("normalized_salary", 124000.0).alias("salary"))
