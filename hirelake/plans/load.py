"""The whole load: files to raw, raw to cleaned, cleaned to the star schema."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hirelake.fixed_values import CLEANED_TABLES, LAYERS, MODEL_TABLES, RAW_INDEXES, RAW_TABLES
from hirelake.operators.ordering import sequential_id
from hirelake.operators.projection import normalize_columns
from hirelake.plans import cleaning, star
from hirelake.sources import layers
from hirelake.sources.csv import SEQ, read_csv_tables
from hirelake.sources.schemas import RAW_SCHEMAS
from hirelake.sources.staging import releasing

KEPT_SECONDS = 86_400.0
CLEANERS = {
    "jobs": cleaning.clean_jobs,
    "salaries": cleaning.clean_salaries,
    "benefits": cleaning.clean_benefits,
    "employee_counts": cleaning.clean_employee_counts,
    "industries": cleaning.clean_industries,
    "companies": cleaning.clean_companies,
}


@dataclass(frozen=True)
class Layers:
    raw: str = LAYERS[0]
    cleaned: str = LAYERS[1]
    model: str = LAYERS[2]

    @classmethod
    def with_suffix(cls, suffix: str) -> Layers:
        return cls(*[f"{name}_{suffix}" for name in LAYERS])


def load_raw(
    spark: SparkSession, paths: Mapping[str, str], namespace: str, csv_mode: str = "auto", cluster: int | None = None
) -> dict[str, int]:
    """Files to raw tables, given a number in `cluster` clustered by their index columns into that many parts."""
    tables = read_csv_tables(spark, paths, RAW_SCHEMAS, mode=csv_mode)
    if cluster:
        keys = {t: [c for c in RAW_INDEXES[t] if c in df.columns] for t, df in tables.items()}
        tables |= {t: layers.layout_by_key(df, keys[t], cluster) for t, df in tables.items() if keys[t]}
    return layers.load_raw_replace(tables, namespace)


def load_cleaned(spark: SparkSession, names: Layers, skip_empty: bool = True, skills: bool = False) -> dict[str, int]:
    """Clean and store every table; from here on `_seq` is a plain row number.

    A number is shorter to shuffle than a place in a file, and aggregates on it can hash.
    `skip_empty` keeps the older rows of a table that comes out empty. All tables become visible by
    one commit. `skills` also stores skills_industries, as it is but for its column names.
    """
    cleaners = CLEANERS | ({"skills_industries": normalize_columns} if skills else {})

    def job(table: str, raw: DataFrame) -> int:
        if table == "jobs" or SEQ not in raw.columns:
            df = cleaners[table](raw)
        elif table == "salaries":  # keeps every row, and the passes for its cap need no numbers
            df = sequential_id(cleaners[table](raw), [SEQ], [SEQ])
        else:
            df = cleaners[table](sequential_id(raw, [SEQ], [SEQ]))
        return commit.store(df, table, skip_empty)

    raw = {t: layers.scan_table(spark, names.raw, t) for t in cleaners}
    with layers.Commit(spark, names.cleaned) as commit:
        return layers.side_by_side(raw, job)


def copy_cleaned(spark: SparkSession, names: Layers, files: str, run_id: str) -> dict[str, str]:
    """Copy the stored cleaned tables to parquet files of this run; returns their paths."""
    stored = {
        t: layers.scan_table(spark, names.cleaned, t)
        for t in CLEANED_TABLES
        if layers.table_exists(spark, names.cleaned, t)
    }
    return layers.write_parquet_run(stored, files, run_id)


def load_model(spark: SparkSession, names: Layers, skip_empty: bool = True) -> dict[str, int]:
    """Each dimension is stored before the fact reads it, so nothing is computed twice.

    All four tables become visible by one commit; a failure on the way leaves the four old ones.
    """

    def cleaned(table: str) -> DataFrame | None:
        if not layers.table_exists(spark, names.cleaned, table):
            return None
        return layers.scan_table(spark, names.cleaned, table)

    def store(table: str, df: DataFrame) -> DataFrame:
        counts[table] = commit.store(df, table, skip_empty)
        stored = commit.table(table)
        return df if stored is None else stored

    counts: dict[str, int] = {}
    for required in ("jobs", "companies"):
        if cleaned(required) is None:
            raise ValueError(f"{required} is required but missing")
        layers.require_nonempty(cleaned(required), required)
    jobs = cleaned("jobs")
    with layers.Commit(spark, names.model) as commit:
        company = store(
            "dim_company",
            star.dim_company(cleaned("companies"), cleaned("employee_counts"), cleaned("industries")),
        )
        location = store("dim_location", star.dim_location(company))
        time = store("dim_time", star.dim_time(jobs))
        store("fact_jobs", star.fact_jobs(jobs, company, location, time, cleaned("benefits"), cleaned("salaries")))
    return counts


def run_pipeline(
    spark: SparkSession,
    paths: Mapping[str, str],
    warehouse: str,
    run_id: str,
    force: bool = False,
    names: Layers = Layers(),
    csv_mode: str = "auto",
    copies: bool = True,
    cluster: int | None = None,
    skills: bool = False,
    keep: float = KEPT_SECONDS,
) -> DataFrame:
    """Load what is missing, rebuild the star schema, and return the manifest of the run.

    Raw and cleaned are loaded only when a table of theirs is missing or empty, or with
    `force`; the star schema is rebuilt every time. `copies=False` leaves out the parquet
    copies of freshly cleaned tables and the CSV copies of the star schema. `cluster` lays the
    raw tables out by key, for readers that filter them by it. Tables that come out empty keep
    their older rows, but not with `force`. `skills` also stores skills_industries among the
    cleaned tables. Each layer changes by one commit, and what it showed more than `keep` seconds
    ago is removed at the end, as is what was staged on the way. The manifest is also appended to
    the table of runs in the layer of the star schema.
    """
    with releasing(spark):
        manifest = _run(spark, paths, warehouse, run_id, force, names, csv_mode, copies, cluster, skills)
    layers.record_run(manifest, names.model)
    for layer in (names.raw, names.cleaned, names.model):
        layers.vacuum(spark, layer, age=keep)
    return manifest


def _run(spark, paths, warehouse, run_id, force, names, csv_mode, copies, cluster, skills) -> DataFrame:
    layers.create_namespaces(spark, (names.raw, names.cleaned, names.model), warehouse)
    layers.run_if_needed(
        force or layers.needs_extraction(spark, names.raw, RAW_TABLES),
        lambda: load_raw(spark, paths, names.raw, csv_mode, cluster),
    )
    cleaned = layers.run_if_needed(
        force or layers.needs_cleaning(spark, names.cleaned, (*CLEANED_TABLES, *(("skills_industries",) if skills else ()))),
        lambda: load_cleaned(spark, names, skip_empty=not force, skills=skills),
    )
    counts = {**load_model(spark, names, skip_empty=not force), **(cleaned or {})}
    files: dict[str, str] = {}
    if copies:
        if cleaned:
            files |= copy_cleaned(spark, names, f"{warehouse}/cleaned_files", run_id)
        model = {t: layers.scan_table(spark, names.model, t) for t in MODEL_TABLES if counts[t]}
        files |= layers.write_csv_backup(model, f"{warehouse}/model_backup/{run_id}")
    return layers.run_manifest(spark, run_id, counts, files)
