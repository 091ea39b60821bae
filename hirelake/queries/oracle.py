"""Named SQL parts that the oracle statements are put together from."""

from __future__ import annotations

import re

from hirelake.fixed_values import CLEANING_RATES, MODEL_RATES, PERIODS_PER_YEAR
from hirelake.queries.bindings import VIEWS


def case_factor(code: str, factors: dict[str, float]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {float(v)}e0" for k, v in factors.items())
    return f"(CASE {code} {whens} ELSE 1e0 END)"


PERIOD = "upper(coalesce(pay_period, 'YEARLY'))"
YEARLY_FACTOR = case_factor(PERIOD, PERIODS_PER_YEAR)
CLEANING_RATE = case_factor("currency", CLEANING_RATES)
MODEL_RATE = case_factor("currency", MODEL_RATES)
UNIFIED = "coalesce(med_salary, (min_salary + max_salary) / 2, min_salary, max_salary)"


def quantile(values: str, q: float) -> str:
    """Linear interpolation between the neighbours in the sorted list `values`; null for an empty one."""
    pos = f"({q}e0 * (len({values}) - 1))"
    low = f"{values}[CAST(floor({pos}) AS BIGINT) + 1]"
    high = f"{values}[CAST(ceil({pos}) AS BIGINT) + 1]"
    t = f"({pos} - floor({pos}))"
    return (
        f"(CASE WHEN {t} < 0.5e0 THEN {low} + ({high} - {low}) * {t} "
        f"ELSE {high} - ({high} - {low}) * (1 - {t}) END)"
    )


def sorted_list(col: str) -> str:
    return f"list_sort(list(CAST({col} AS DOUBLE)) FILTER ({col} IS NOT NULL))"


def cap_of(col: str, table: str) -> str:
    """Scalar subquery for the upper cap of a column."""
    q1, q3 = quantile("l", 0.25), quantile("l", 0.75)
    return f"(SELECT {q3} + 1.5e0 * ({q3} - {q1}) FROM (SELECT {sorted_list(col)} AS l FROM {table}))"


def capped(col: str, table: str) -> str:
    cap = cap_of(col, table)
    return f"CASE WHEN {col} > {cap} THEN {cap} ELSE {col} END"


LISTED = "make_timestamp(CAST(original_listed_time AS BIGINT) * 1000)"
REPAIRED_JOB = f"""job_id, title, coalesce(CAST(company_id AS BIGINT), -1) AS company_id,
 coalesce(CAST(views AS BIGINT), 0) AS views, coalesce(remote_allowed, 0) <> 0 AS remote_allowed,
 {LISTED} AS original_listed_time,
 coalesce(CAST(zip_code AS VARCHAR), 'No specified') AS zip_code,
 coalesce(formatted_experience_level, 'No specified') AS formatted_experience_level,
 row_number() OVER (ORDER BY job_id) AS job_id_modify, row_number() OVER (ORDER BY job_id) AS company_id_modify"""

PARTS = {
    **{name: text.format(**{table: table}) for name, (table, text) in VIEWS.items()},
    "p_jobs": f"SELECT *, normalized_salary * {CLEANING_RATE} * {YEARLY_FACTOR} AS yearly FROM v_jobs",
    "c_jobs": f"""SELECT {REPAIRED_JOB}, {capped('yearly', 'p_jobs')} AS normalized_salary,
 'YEARLY' AS pay_period, 'USD' AS currency FROM p_jobs""",
    "p_salaries": f"SELECT *, {UNIFIED} * {YEARLY_FACTOR} AS yearly FROM v_salaries",
    "c_salaries": f"""SELECT job_id, l_linenumber, l_partkey, l_suppkey, 'YEARLY' AS pay_period, currency,
 {capped('yearly', 'p_salaries')} AS normalized_salary FROM p_salaries""",
    "c_benefits": """SELECT job_id, string_agg(coalesce(type, 'NULL'), '|'
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, type NULLS FIRST) AS type, 0 AS _part,
 count(*) AS items FROM v_benefits GROUP BY job_id""",
    "c_employee_counts": """SELECT company_id, employee_count, follower_count,
 CAST(make_timestamp(time_recorded * 1000000) AS DATE) AS time_recorded, _seq FROM v_employee_counts""",
    "c_industries": "SELECT company_id, coalesce(industry, 'Unknown') AS industry, _seq FROM v_industries",
    "c_companies": f"""SELECT company_id, name,
 CAST(trunc(coalesce(company_size, (SELECT {quantile('l', 0.5)} FROM
  (SELECT {sorted_list('company_size')} AS l FROM v_companies)))) AS BIGINT) AS company_size,
 country, CASE WHEN state IS NULL OR state = '0' THEN 'Unknown' ELSE state END AS state,
 coalesce(city, 'Unknown') AS city,
 CASE WHEN zip_code IS NULL OR zip_code = '0' THEN 'Unknown' ELSE zip_code END AS zip_code,
 coalesce(description, 'No description') AS description, coalesce(address, 'No specific address') AS address
 FROM v_companies WHERE name IS NOT NULL""",
    "last_count": """SELECT company_id, employee_count FROM v_employee_counts
 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY _seq DESC) = 1""",
    "first_industry": """SELECT company_id, industry FROM c_industries
 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY _seq) = 1""",
    "first_salary": """SELECT job_id, normalized_salary, currency, pay_period FROM c_salaries
 QUALIFY row_number() OVER (PARTITION BY job_id
  ORDER BY l_linenumber, l_partkey, l_suppkey, normalized_salary NULLS FIRST) = 1""",
    "d_company": """SELECT c.company_id, name, CAST(company_size AS VARCHAR) AS company_size,
 coalesce(employee_count, 0) AS employee_count, coalesce(industry, 'Unknown') AS industry,
 coalesce(country, 'None') AS country, city, state, zip_code,
 c.company_id || '_' || substr(name, 1, 3) AS company_key
 FROM c_companies c LEFT JOIN last_count e ON c.company_id = e.company_id
 LEFT JOIN first_industry i ON c.company_id = i.company_id""",
    "d_location": """SELECT DISTINCT city, state, zip_code, country, country || state AS location_key FROM d_company""",
    "d_time": """SELECT DISTINCT strftime(d, '%Y%m%d') AS time_key, CAST(year(d) AS INTEGER) AS year,
 CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day
 FROM (SELECT CAST(original_listed_time AS DATE) AS d FROM c_jobs WHERE original_listed_time IS NOT NULL)""",
    "f_jobs": """SELECT j.job_id, d.company_key, l.location_key,
 strftime(j.original_listed_time, '%Y%m%d') AS time_key, j.title, j.views, j.remote_allowed,
 coalesce(b.items, 0) AS benefits_count, least(coalesce(j.normalized_salary, 0e0), 124000e0) AS normalized_salary,
 'USD' AS currency, 'YEARLY' AS pay_period
 FROM c_jobs j LEFT JOIN d_company d ON j.company_id = d.company_id
 LEFT JOIN d_location l ON d.city = l.city AND d.state = l.state AND d.zip_code = l.zip_code AND d.country = l.country
 LEFT JOIN c_benefits b ON j.job_id = b.job_id""",
}

_WORD = re.compile(r"\b[a-z]\w*\b")


def statement(sql: str) -> str:
    """`sql` with every named part it uses, directly or not, as a common table expression before it."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in PARTS and word not in needed:
                visit(PARTS[word])
                needed[word] = None

    visit(sql)
    parts = ",\n".join(f"{name} AS ({PARTS[name].strip()})" for name in needed)
    return f"WITH {parts}\n{sql}" if needed else sql
