"""Cleaned tables, star schema and the whole load on hand-written rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from hirelake.fixed_values import FACT_COLUMNS, MODEL_TABLES
from hirelake.operators import skew
from hirelake.plans import cleaning, load, star
from hirelake.queries.bindings import BENEFITS_ORDER, Views
from hirelake.queries.oracle import statement
from hirelake.sources import layers
from tests.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"
JOBS = "job_id bigint, company_id bigint, title string, views bigint, remote_allowed boolean, original_listed_time timestamp_ntz"
COMPANIES = "company_id bigint, name string, company_size bigint, country string, city string, state string, zip_code string"


def company(spark, *rows):
    return spark.createDataFrame(list(rows), COMPANIES)


ACME = (1, "Acme", 3, None, "Reno", "CA", "94105")
OTHER = (2, "Other", 1, None, "Napa", "CA", "94558")


def fact(spark, companies, jobs=None, **kwargs):
    dim = star.dim_company(companies)
    jobs = jobs if jobs is not None else spark.createDataFrame([(10, 1, "a", 5, True, None)], JOBS)
    return star.fact_jobs(jobs, dim, star.dim_location(dim), star.dim_time(jobs), **kwargs)


# Cleaning


def test_median_counts_companies_without_a_name(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", None), (3, None, 9.0), (4, None, 9.0)], "company_id int, name string, company_size double"
    )
    assert sorted(cleaning.clean_companies(df).collect()) == [(1, "a", 1), (2, "b", 9)]


def test_jobs_without_optional_columns(spark):
    df = spark.createDataFrame([(5, "x", 1), (6, "y", 2)], "`Job ID` int, title string, _seq int")
    cleaned = cleaning.clean_jobs(df).orderBy("job_id").collect()
    assert [r.asDict() for r in cleaned] == [
        {"job_id": 5, "title": "x", "job_id_modify": 1, "company_id_modify": 1},
        {"job_id": 6, "title": "y", "job_id_modify": 2, "company_id_modify": 2},
    ]


def test_salaries_may_already_be_yearly(spark):
    df = spark.createDataFrame([(1, 100.0, "HOURLY")], "_seq int, normalized_salary double, pay_period string")
    assert cleaning.clean_jobs(df).first().normalized_salary == 208000.0
    assert cleaning.clean_jobs(df, annualize=False).first().normalized_salary == 100.0


def test_all_salaries_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "EUR")], "_seq int, normalized_salary double, currency string")
    assert [r.normalized_salary for r in cleaning.clean_jobs(df).collect()] == [None, None]


def test_notebook_cleaners_without_optional_columns(spark):
    jobs = spark.createDataFrame([(5, 1)], "job_id int, _seq int")
    assert cleaning.clean_jobs_notebook(jobs).first().asDict() == {"job_id": 5, "job_id_modify": 1, "company_id_modify": 1}
    salaries = spark.createDataFrame([(5, 10.0, 20.0)], "job_id int, min_salary double, max_salary double")
    assert cleaning.clean_salaries_notebook(salaries).first() == (5, 10.0, 20.0, 15.0)
    assert cleaning.clean_salaries_notebook(salaries.select("job_id")).first() == (5, None)


def test_industry_name_variant(spark):
    df = spark.createDataFrame([(1, None), (2, "Mining")], "company_id int, industry_name string")
    assert sorted(cleaning.clean_industries(df).collect()) == [(1, "Unknown", "Unknown"), (2, "Mining", "Mining")]


# Star schema


def test_last_count_is_null_then_zero(spark):
    counts = spark.createDataFrame([(1, 7, 1), (1, None, 2)], "company_id bigint, employee_count bigint, _seq int")
    dim = star.dim_company(company(spark, ACME), counts).first()
    assert (dim.employee_count, dim.industry, dim.company_size) == (0, "Unknown", "3")


def test_null_country_and_shared_location_key(spark):
    dim = star.dim_company(company(spark, ACME, OTHER))
    keys = [r.location_key for r in star.dim_location(dim).collect()]
    assert keys == ["NoneCA", "NoneCA"]


def test_unknown_company_has_no_keys(spark):
    jobs = spark.createDataFrame([(10, -1, "a", None, None, None)], JOBS)
    row = fact(spark, company(spark, ACME), jobs).first()
    assert (row.company_key, row.location_key, row.views, row.remote_allowed) == (None, None, 0, False)


def test_repeated_company_repeats_its_jobs(spark):
    again = (1, "Bcme", 3, "US", "Reno", "CA", "94105")
    rows = fact(spark, company(spark, ACME, again)).select("company_key", "location_key").collect()
    assert sorted(rows) == [("1_Acm", "NoneCA"), ("1_Bcm", "USCA")]


def test_null_company_ids_match_each_other(spark):
    jobs = spark.createDataFrame([(10, None, "a", 1, True, None)], JOBS)
    nameless = (None, "Ghost", 1, "US", "x", "y", "z")
    assert fact(spark, company(spark, nameless), jobs).first().company_key == "nan_Gho"


def test_days_and_foreign_keys(spark):
    jobs = spark.sql(
        "SELECT 1L AS job_id, 1L AS company_id, 'a' AS title, timestamp_ntz'2024-02-29 23:59:59' AS original_listed_time"
        " UNION ALL SELECT 2L, 1L, 'b', timestamp_ntz'2024-02-29 00:00:00' UNION ALL SELECT 3L, 1L, 'c', NULL"
    )
    assert star.dim_time(jobs).collect() == [("20240229", 2024, 2, 29)]
    rows = fact(spark, company(spark, ACME), jobs).orderBy("job_id").collect()
    assert [r.time_key for r in rows] == ["20240229", "20240229", None]
    assert "views" not in rows[0].asDict()
    nothing = star.fk_nullify(spark.createDataFrame([("x",)], "k string"), "k", star.dim_time(jobs), "time_key")
    assert nothing.first().k is None


def test_salary_comes_from_the_salaries_table(spark):
    salaries = spark.createDataFrame(
        [(10, 50.0, "EUR", "YEARLY", 2), (10, 40.0, "EUR", "MONTHLY", 1)],
        "job_id bigint, normalized_salary double, currency string, pay_period string, _seq int",
    )
    row = fact(spark, company(spark, ACME), salaries=salaries).first()
    assert (row.normalized_salary, row.currency, row.pay_period) == (pytest.approx(40 * 1.1 * 12), "USD", "YEARLY")


def test_only_missing_salary_columns_are_filled(spark):
    jobs = spark.createDataFrame(
        [(10, 1, "a", 100.0)], "job_id bigint, company_id bigint, title string, normalized_salary double"
    )
    salaries = spark.createDataFrame(
        [(10, 50.0, "EUR", 1)], "job_id bigint, normalized_salary double, currency string, _seq int"
    )
    row = fact(spark, company(spark, ACME), jobs, salaries=salaries).first()
    assert (row.normalized_salary, row.currency, row.pay_period) == (pytest.approx(110), "USD", "YEARLY")


def test_uncleaned_salaries_are_converted_and_capped(spark):
    jobs = spark.createDataFrame(
        [(1, 1, "a", 100.0, "CAD", "hourly"), (2, 1, "b", None, None, None), (3, 1, "c", 10.0, "XYZ", "ONCE")],
        "job_id bigint, company_id bigint, title string, normalized_salary double, currency string, pay_period string",
    )
    rows = fact(spark, company(spark, ACME), jobs).orderBy("job_id").collect()
    assert [r.normalized_salary for r in rows] == [124000.0, 0.0, 10.0]


def test_missing_contract_columns(spark):
    with pytest.raises(KeyError):
        star.dim_company(spark.range(1).withColumnRenamed("id", "company_id"))
    with pytest.raises(KeyError):
        fact(spark, company(spark, ACME), spark.range(1).withColumnRenamed("id", "job_id"))


@pytest.mark.parametrize("partitions", [1, 17])
def test_fact_does_not_depend_on_the_layout(spark, rows, partitions):
    views = Views(spark, FOLDER)
    expected, actual = (
        star.fact_jobs(
            cleaning.clean_jobs(shape(views.jobs), ["job_id"]),
            dim := star.dim_company(cleaning.clean_companies(shape(views.companies)), shape(views.employee_counts)),
            star.dim_location(dim),
            star.dim_time(cleaning.clean_jobs(shape(views.jobs), ["job_id"])),
            cleaning.clean_benefits(shape(views.benefits), BENEFITS_ORDER),
        )
        for shape in (lambda df: df, lambda df: df.repartition(partitions))
    )
    assert rows(actual) == rows(expected)


def test_fact_with_a_third_of_jobs_at_one_company(spark, rows, monkeypatch, capsys):
    jobs = spark.range(3000).select(
        F.col("id").alias("job_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 100).cast("bigint").alias("company_id"),
        F.lit("t").alias("title"),
        (F.col("id") + 1).alias("job_id_modify"),
    )
    companies = company(spark, ACME, OTHER, *[(i, f"Company {i}", 1, "US", "x", f"S{i % 3}", "z") for i in range(3, 60)])
    salted = fact(spark, companies, jobs)
    salted.explain()
    assert "_salt" in capsys.readouterr().out
    monkeypatch.setattr(star, "heavy_keys", lambda df, sets, **_: {n: skew.HeavyKeys() for n in sets})
    assert rows(salted) == rows(fact(spark, companies, jobs))
    assert salted.count() == 3000


# The whole load


def stored(spark, names, table):
    return sorted(map(repr, layers.scan_table(spark, names.model, table).collect()))


@pytest.mark.parametrize("csv_mode, cluster", [("auto", None), ("split", 3)])
def test_second_run_skips_loading_and_gives_equal_tables(spark, tmp_path, csv_mode, cluster):
    raw = {name: df.drop("_seq") for name, df in Views(spark, FOLDER).raw().items()}
    paths = layers.write_csv_backup(raw, str(tmp_path / "source"))
    names = load.Layers.with_suffix(uuid.uuid4().hex[:8])

    def run(run_id, **kwargs):
        how = {"names": names, "csv_mode": csv_mode, "cluster": cluster, **kwargs}
        manifest = load.run_pipeline(spark, paths, str(tmp_path / "wh"), run_id, **how)
        return {r.table_name: r for r in manifest.collect()}

    first = run("r1")
    tables = {t: stored(spark, names, t) for t in MODEL_TABLES}
    assert layers.scan_table(spark, names.model, "fact_jobs").columns == list(FACT_COLUMNS)
    assert first["fact_jobs"].row_count == raw["jobs"].count()
    assert (tmp_path / "wh/cleaned_files/r1/jobs_cleaned.parquet").exists()
    assert (tmp_path / "wh/model_backup/r1/fact_jobs.csv").exists()
    number = F.col("job_id_modify")
    jobs = layers.scan_table(spark, names.cleaned, "jobs")
    numbers = jobs.agg(F.min(number), F.max(number), F.count_distinct(number)).first()
    assert tuple(numbers) == (1, first["fact_jobs"].row_count, first["fact_jobs"].row_count)

    connection = oracle_connection(FOLDER)
    parts = ("d_company", "d_location", "d_time", "f_jobs")
    for table, part in zip(MODEL_TABLES, parts):
        found = layers.scan_table(spark, names.model, table)
        assert difference(found, connection, statement(f"SELECT * FROM {part}")) is None

    counts = layers.scan_table(spark, names.cleaned, "employee_counts")
    assert dict(counts.dtypes)["_seq"] == "bigint"
    assert counts.agg(F.min("_seq"), F.max("_seq")).first() == (1, raw["employee_counts"].count())

    second = run("r2")
    assert "jobs" not in second and {t: stored(spark, names, t) for t in MODEL_TABLES} == tables
    forced = run("r3", force=True)
    assert "jobs" in forced and {t: stored(spark, names, t) for t in MODEL_TABLES} == tables


def test_a_failure_between_two_star_tables_leaves_all_four(spark, tmp_path, monkeypatch):
    raw = {name: df.drop("_seq") for name, df in Views(spark, FOLDER).raw().items()}
    names = load.Layers.with_suffix(uuid.uuid4().hex[:8])
    paths = layers.write_csv_backup(raw, str(tmp_path / "source"))

    def run(run_id, **kwargs):
        return load.run_pipeline(spark, paths, str(tmp_path / "wh"), run_id, names=names, copies=False, **kwargs)

    run("r1")
    tables = {t: stored(spark, names, t) for t in MODEL_TABLES}
    fewer = raw["companies"].filter("company_id > 20")
    paths |= layers.write_csv_backup({"companies": fewer}, str(tmp_path / "fewer"))

    def broken(*_):
        raise RuntimeError("no fact")

    monkeypatch.setattr(star, "fact_jobs", broken)
    with pytest.raises(RuntimeError, match="no fact"):
        run("r2", force=True)
    assert {t: stored(spark, names, t) for t in MODEL_TABLES} == tables
    monkeypatch.undo()
    run("r3", force=True, skills=True, keep=0)
    assert all(stored(spark, names, t) != tables[t] for t in ("dim_company", "fact_jobs"))
    assert layers.scan_table(spark, names.cleaned, "skills_industries").count() == raw["skills_industries"].count()
    runs = layers.run_history(spark, names.model)
    assert {r.run_id for r in runs.collect()} == {"r1", "r3"}
    assert len(list((tmp_path / "wh" / names.model / "fact_jobs").iterdir())) == 1
    assert layers.history(spark, names.model).select("version").distinct().count() == 2


def test_added_parts_make_the_rollup_of_all_rows(spark, rows):
    views = Views(spark, FOLDER)
    companies = star.dim_company(cleaning.clean_companies(views.companies), views.employee_counts)
    jobs = cleaning.clean_jobs(views.jobs, ["job_id"])
    days = star.dim_time(jobs)
    whole = star.fact_jobs(jobs, companies, star.dim_location(companies), days)
    parts = [star.rollup_parts(whole.filter(F.pmod(F.col("job_id"), F.lit(3)) == i)) for i in range(3)]
    added = star.add_parts(star.add_parts(parts[0], parts[1]), parts[2])
    assert rows(star.rollup_of_parts(added, companies, days)) == rows(star.star_rollup(whole, companies, days))


def test_a_forced_load_of_an_empty_table_leaves_no_old_rows(spark, tmp_path):
    raw = {name: df.drop("_seq") for name, df in Views(spark, FOLDER).raw().items()}
    paths = layers.write_csv_backup(raw, str(tmp_path / "source"))
    names = load.Layers.with_suffix(uuid.uuid4().hex[:8])

    def run(run_id, **kwargs):
        load.run_pipeline(spark, paths, str(tmp_path / "wh"), run_id, names=names, copies=False, **kwargs)
        return layers.scan_table(spark, names.cleaned, "benefits").count()

    assert run("r1") > 0
    (tmp_path / "none.csv").write_text("job_id,inferred,type,l_linenumber\n")
    paths["benefits"] = str(tmp_path / "none.csv")
    assert run("r2") > 0
    assert run("r3", force=True) == 0
    fact = layers.scan_table(spark, names.model, "fact_jobs")
    assert fact.count() == raw["jobs"].count() and fact.filter("benefits_count > 0").isEmpty()


@pytest.mark.parametrize("name, most", [("fact_jobs", 10), ("star_rollup", 10), ("dim_time", 0), ("fk_nullify", 0)])
def test_few_jobs_run_before_the_query(spark, name, most):
    queries()[name](spark, FOLDER)
    tracker = spark.sparkContext.statusTracker()
    group = f"before-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        queries()[name](spark, FOLDER)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Reading the schema of a given table takes a job, which any query has.
    schemas = {"fact_jobs": 4, "star_rollup": 4, "dim_time": 1, "fk_nullify": 1}[name]
    assert len(tracker.getJobIdsForGroup(group)) <= most + schemas


def test_load_needs_jobs(spark, tmp_path):
    names = load.Layers.with_suffix(uuid.uuid4().hex[:8])
    layers.create_namespaces(spark, (names.raw, names.cleaned, names.model), str(tmp_path))
    with pytest.raises(ValueError):
        load.load_model(spark, names)
