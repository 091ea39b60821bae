"""Queries that write whole tables to files or a layer of their own and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hirelake.queries.bindings import Views
from hirelake.queries.registry import query
from hirelake.session import fresh_path
from hirelake.sources import csv, layers
from hirelake.sources.schemas import RAW_SCHEMAS


def fresh_layer(v: Views, label: str = "raw") -> str:
    """A new, empty layer in the shared folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    layers.create_namespaces(v.spark, [name], fresh_path(v.spark, "warehouse"))
    return name


def write_csv(v: Views, tables: dict) -> dict[str, str]:
    return layers.write_csv_backup(tables, fresh_path(v.spark, "csv"))


JOB_COLUMNS = (
    "job_id", "company_id", "title", "views", "remote_allowed", "original_listed_time", "normalized_salary",
    "pay_period", "currency", "zip_code", "formatted_experience_level", "closed_time",
)


@query(f"SELECT {', '.join(JOB_COLUMNS)} FROM v_jobs")
def read_csv_tables(v):
    paths = write_csv(v, {"jobs": v.jobs})
    return csv.read_csv_tables(v.spark, paths, RAW_SCHEMAS)["jobs"].select(*JOB_COLUMNS)


@query("SELECT job_id, currency, pay_period, formatted_experience_level FROM v_jobs")
def na_tokens(v):
    tokens = {"currency": "N/A", "pay_period": "null", "formatted_experience_level": "<NA>"}
    spelled = {c: F.coalesce(F.col(c), F.lit(token)) for c, token in tokens.items()}
    return csv.na_tokens_to_null(v.jobs.select("job_id", *tokens).withColumns(spelled))


@query("SELECT company_id, industry, _seq AS place FROM v_industries")
def require_files(v):
    paths = write_csv(v, {"industries": v.industries.withColumnRenamed("_seq", "place")})
    paths["companies"] = paths["industries"] + ".absent"
    (table,) = csv.read_csv_tables(v.spark, paths, RAW_SCHEMAS, strict=False).values()
    return table.select("company_id", "industry", F.col("place").cast("bigint").alias("place"))


@query("SELECT * FROM v_employee_counts")
def load_raw_replace(v):
    layer = fresh_layer(v)
    for _ in range(2):
        layers.load_raw_replace({"Employee_Counts": v.employee_counts}, layer)
    return layers.scan_table(v.spark, layer, "employee_counts")


@query("SELECT * FROM v_salaries")
def scan_table(v):
    layer = fresh_layer(v)
    layers.replace_table(v.salaries, layer, "salaries")
    return layers.scan_table(v.spark, layer, "salaries")


@query("SELECT * FROM v_industries")
def write_parquet_run(v):
    tables = {"industries": v.industries, "none": v.industries.filter("false")}
    paths = layers.write_parquet_run(tables, fresh_path(v.spark, "runs"), "run_1")
    return v.spark.read.parquet(*paths.values())


@query("SELECT * FROM v_companies")
def replace_table(v):
    layer = fresh_layer(v)
    layers.replace_table(v.companies.drop("address"), layer, "companies")
    layers.replace_table(v.companies, layer, "companies")
    layers.replace_table(v.companies.filter("false"), layer, "companies")
    return layers.scan_table(v.spark, layer, "companies")


@query("""SELECT CAST(company_id AS VARCHAR) AS company_id, name, CAST(company_size AS VARCHAR) AS company_size,
 country, city, state, zip_code FROM v_companies""")
def write_csv_backup(v):
    columns = ("company_id", "name", "company_size", "country", "city", "state", "zip_code")
    paths = write_csv(v, {"dim_company": v.companies.select(*columns)})
    return v.spark.read.csv(paths["dim_company"], header=True)


@query("""SELECT 'companies' AS table_name, count(*) AS row_count FROM v_companies
UNION ALL SELECT 'salaries', count(*) FROM v_salaries""")
def rowcount_validate(v):
    layer = fresh_layer(v, "cleaned")
    rows = []
    for name in ("companies", "salaries"):
        expected = layers.replace_table(getattr(v, name), layer, name)
        rows.append((name, layers.rowcount_validate(v.spark, layer, name, expected)))
    return v.spark.createDataFrame(rows, "table_name string, row_count bigint")


_MANIFEST = """SELECT '{run}' AS run_id, 'companies' AS table_name, count(*) AS row_count, true AS has_copy FROM v_companies
UNION ALL SELECT '{run}', 'benefits', count(*), false FROM v_benefits"""


@query(" UNION ALL ".join(_MANIFEST.format(run=run) for run in ("run_1", "run_2")))
def run_manifest(v):
    """The recorded manifests of two runs."""
    layer = fresh_layer(v, "cleaned")
    for run in ("run_1", "run_2"):
        counts = {name: layers.replace_table(getattr(v, name), layer, name) for name in ("companies", "benefits")}
        stored = {"companies": layers.scan_table(v.spark, layer, "companies")}
        paths = layers.write_parquet_run(stored, fresh_path(v.spark, "runs"), run)
        layers.record_run(layers.run_manifest(v.spark, run, counts, paths), layer)
    runs = layers.run_history(v.spark, layer)
    return runs.select("run_id", "table_name", "row_count", F.col("path").isNotNull().alias("has_copy"))


_STORED_COUNTS = """SELECT 'companies' AS table_name, count(*) AS row_count FROM v_companies
UNION ALL SELECT 'employee_counts', count(*) FROM v_employee_counts
UNION ALL SELECT 'industries', count(*) FROM v_industries"""


@query(_STORED_COUNTS)
def list_tables(v):
    layer = fresh_layer(v)
    for name in ("industries", "companies", "employee_counts"):
        layers.replace_table(getattr(v, name), layer, name)
    names = [row.table_name for row in layers.list_tables(v.spark, layer).collect()]
    counts = [(n, layers.scan_table(v.spark, layer, n).count()) for n in names]
    return v.spark.createDataFrame(counts, "table_name string, row_count bigint")


_RANGES = {"job_id": (1000, 1100), "l_partkey": (20, 25)}


@query("\nUNION ALL ".join(
    f"SELECT '{key}' AS index_key, (SELECT count(*) FROM v_salaries) AS row_count, count(*) AS rows_found, true AS few_files "
    f"FROM v_salaries WHERE {key} BETWEEN {low} AND {high}"
    for key, (low, high) in _RANGES.items()
))
def layout_by_key(v):
    """Clustered by two keys; for a filter on each, the rows found and whether it reads at most half of the files."""
    layer = fresh_layer(v)
    layers.replace_table(layers.layout_by_key(v.salaries, list(_RANGES), 16), layer, "salaries")
    table = layers.scan_table(v.spark, layer, "salaries")
    found = []
    for key, (low, high) in _RANGES.items():
        files, of = layers.files_read(table, key, F.lit(low), F.lit(high)).first()
        rows = table.filter(F.col(key).between(low, high)).count()
        found.append((key, table.count(), rows, 2 * files <= of))
    return v.spark.createDataFrame(found, "index_key string, row_count bigint, rows_found bigint, few_files boolean")


@query("""SELECT 2 AS version, 'companies' AS table_name, count(*) AS row_count FROM v_companies
UNION ALL SELECT 1, 'companies', count(*) FROM v_companies WHERE company_id > 100
UNION ALL SELECT 1, 'salaries', count(*) FROM v_salaries""")
def table_history(v):
    """The log of a layer after a commit of two tables and a replacement of one."""
    layer = fresh_layer(v)
    layers.replace_tables({"companies": v.companies.filter("company_id > 100"), "salaries": v.salaries}, layer)
    layers.replace_table(v.companies, layer, "companies")
    return layers.history(v.spark, layer).select(F.col("version").cast("int").alias("version"), "table_name", "row_count")
