"""The raw job-posting tables as views of the given tables, in SQL that Spark and DuckDB both read.

Every view holds all rows of its table. Some ids are made negative, so that there are jobs and
companies without any related row, as well as related rows without a job or company.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# View name -> (given table, SQL).
VIEWS = {
    "v_jobs": (
        "orders",
        """
SELECT o_orderkey AS job_id,
 CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS company_id,
 'Role ' || o_orderpriority AS title,
 CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE CAST(o_orderkey % 200 AS DOUBLE) END AS views,
 CASE WHEN o_orderkey % 8 = 0 THEN CAST(1 AS DOUBLE) ELSE NULL END AS remote_allowed,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL
  ELSE CAST(1700000000000 + ((o_orderkey * 7919) % 120) * 21600000 AS DOUBLE) END AS original_listed_time,
 CASE WHEN o_orderkey % 10 < 3 THEN o_totalprice ELSE NULL END AS normalized_salary,
 CASE WHEN o_orderkey % 13 = 0 THEN 'hourly' WHEN o_orderkey % 13 = 1 THEN 'MONTHLY'
  WHEN o_orderkey % 13 = 2 THEN 'Weekly' WHEN o_orderkey % 13 = 3 THEN 'BIWEEKLY'
  WHEN o_orderkey % 13 = 4 THEN 'ONCE' WHEN o_orderkey % 13 < 8 THEN 'YEARLY' ELSE NULL END AS pay_period,
 CASE WHEN o_orderkey % 11 = 0 THEN 'EUR' WHEN o_orderkey % 11 = 1 THEN 'GBP'
  WHEN o_orderkey % 11 = 2 THEN 'CAD' WHEN o_orderkey % 11 = 3 THEN 'AUD' WHEN o_orderkey % 11 = 4 THEN 'BBD'
  WHEN o_orderkey % 11 = 5 THEN 'XYZ' WHEN o_orderkey % 11 < 8 THEN 'USD' ELSE NULL END AS currency,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(10000 + o_orderkey % 80000 AS DOUBLE) END AS zip_code,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Level ' || o_orderstatus END AS formatted_experience_level,
 CAST(o_orderkey % 5 AS DOUBLE) AS applies, CAST(NULL AS DOUBLE) AS closed_time,
 'BASE_SALARY' AS compensation_type
FROM {orders}""",
    ),
    "v_companies": (
        "customer",
        """
SELECT c_custkey AS company_id,
 CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE c_name END AS name,
 CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE CAST(c_custkey % 8 AS DOUBLE) END AS company_size,
 CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE 'C' || CAST(c_nationkey AS STRING) END AS country,
 CASE WHEN c_custkey % 9 = 0 THEN '0' WHEN c_custkey % 9 = 1 THEN NULL
  ELSE 'S' || CAST(c_custkey % 7 AS STRING) END AS state,
 CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE 'City ' || CAST(c_custkey % 40 AS STRING) END AS city,
 CASE WHEN c_custkey % 10 = 0 THEN '0' WHEN c_custkey % 10 = 1 THEN NULL
  ELSE CAST(10000 + c_custkey % 60 AS STRING) END AS zip_code,
 CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 'About ' || c_name END AS description,
 CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE 'Street ' || CAST(c_custkey AS STRING) END AS address
FROM {customer}""",
    ),
    "v_employee_counts": (
        "events",
        """
SELECT user_id AS company_id, CAST(floor(value) AS BIGINT) AS employee_count,
 event_id % 1000 AS follower_count, 1700000000 + event_id * 3600 AS time_recorded, event_id AS _seq
FROM {events}""",
    ),
    "v_industries": (
        "orders",
        """
SELECT CASE WHEN o_custkey % 6 = 0 THEN -o_custkey ELSE o_custkey END AS company_id,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'Industry ' || CAST(o_orderkey % 23 AS STRING) END AS industry,
 o_orderkey AS _seq
FROM {orders}""",
    ),
    "v_benefits": (
        "lineitem",
        """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey ELSE -l_orderkey END AS job_id,
 CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE l_returnflag || '-' || l_linestatus END AS type,
 l_linenumber % 2 AS inferred, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM {lineitem}""",
    ),
    "v_salaries": (
        "lineitem",
        """
SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE -l_orderkey END AS job_id,
 l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_linenumber % 4 = 0 THEN l_extendedprice ELSE NULL END AS med_salary,
 CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_linenumber % 4 IN (1, 2) THEN l_extendedprice * 0.5
  ELSE NULL END AS min_salary,
 CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_linenumber % 4 IN (1, 3) THEN l_extendedprice ELSE NULL END AS max_salary,
 CASE WHEN l_suppkey % 5 = 0 THEN 'monthly' WHEN l_suppkey % 5 = 1 THEN 'YEARLY'
  WHEN l_suppkey % 5 = 2 THEN 'HOURLY' ELSE NULL END AS pay_period,
 CASE WHEN l_suppkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS currency
FROM {lineitem}""",
    ),
    "v_skills_industries": ("part", "SELECT p_brand AS skill_abr, min(p_name) AS skill_name FROM {part} GROUP BY p_brand"),
}

BENEFITS_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
SALARIES_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "med_salary", "min_salary", "max_salary")
CLEANED_SALARIES_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "normalized_salary")


class Views:
    """The bound views of one data folder, as lazy frames: `views.jobs`, `views.companies` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.folder = sf_dir
        self._bases: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        if table not in self._bases:
            self._bases[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._bases[table]

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        table, text = VIEWS[f"v_{name}"]
        return self.spark.sql(text, **{table: self.base(table)})

    def raw(self) -> dict[str, DataFrame]:
        return {name[2:]: getattr(self, name[2:]) for name in VIEWS}
