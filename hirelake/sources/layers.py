"""Layers (catalog namespaces), their tables, and the files written beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.fixed_values import CLEANED_TABLES, RAW_TABLES
from hirelake.sources.folders import replace_folder
from hirelake.sources.versions import Commit, history, location, vacuum, validated

__all__ = ["Commit", "history", "vacuum"]  # also reached from here
RUNS = "run_history"
#: A reader takes a CSV file with line breaks in quotes as one task, so files are to be many and not large.
CSV_FILE_ROWS = 1_000_000
RUN_COLUMNS = "run_id string, table_name string, row_count bigint, path string, recorded_at timestamp"
Item, Result = TypeVar("Item"), TypeVar("Result")


def side_by_side(items: Mapping[str, Item], job: Callable[[str, Item], Result]) -> dict[str, Result]:
    """Run one Spark job per table at the same time, so that small tables fill the gaps of large ones."""
    if not items:
        return {}
    with ThreadPoolExecutor(len(items)) as pool:
        started = [pool.submit(copy_context().run, job, name, item) for name, item in items.items()]
        return {name: one.result() for name, one in zip(items, started)}


def create_namespaces(spark: SparkSession, names: Iterable[str], warehouse: str | None = None) -> DataFrame:
    """Create the layers that are absent, check that each is there, and list them."""
    names = list(names)
    for name in names:
        location = f" LOCATION '{warehouse}/{name}'" if warehouse else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{location}")
    missing = [n for n in names if not namespace_exists(spark, n)]
    if missing:
        raise ValueError(f"layers missing after creation: {missing}")
    return spark.createDataFrame([(n, True) for n in names], "namespace string, present boolean")


def scan_table(spark: SparkSession, namespace: str, table: str) -> DataFrame:
    return spark.table(f"{namespace}.{table}")


def replace_table(df: DataFrame, namespace: str, table: str, skip_empty: bool = True) -> int:
    """Write `df` as the new content of a table and return its row count.

    The rows go to a folder of their own, are counted while they are written, and become the table's
    content by one commit to the layer's log (see `versions`), whether the columns changed or not. So
    there is no moment without a table, a failed write leaves the old one, and `df` may read the table
    it replaces. With `skip_empty` an empty result leaves the older table in place. Superseded
    folders stay readable for running queries until `vacuum`.
    """
    with Commit(df.sparkSession, namespace) as commit:
        return commit.store(df, table, skip_empty)


def replace_tables(tables: Mapping[str, DataFrame], namespace: str, skip_empty: bool = True) -> dict[str, int]:
    """Replace several tables side by side, all of them by one commit or, if one fails, none."""
    if not tables:
        return {}
    with Commit(next(iter(tables.values())).sparkSession, namespace) as commit:
        return side_by_side(tables, lambda name, df: commit.store(df, name, skip_empty))


def load_raw_replace(tables: Mapping[str, DataFrame], namespace: str) -> dict[str, int]:
    return replace_tables(tables, namespace, skip_empty=False)


def _write_nonempty(
    tables: Mapping[str, DataFrame], path_of: Callable[[str], str], write: Callable[[DataFrame, str], None]
) -> dict[str, str]:
    def job(name: str, df: DataFrame) -> str | None:
        if df.isEmpty():
            return None
        write(df, path_of(name))
        return path_of(name)

    return {name: path for name, path in side_by_side(tables, job).items() if path}


def write_parquet_run(tables: Mapping[str, DataFrame], base: str, run_id: str) -> dict[str, str]:
    """Each non-empty table to `<base>/<run_id>/<table>_cleaned.parquet`; a rerun that fails leaves the earlier copy."""
    return _write_nonempty(
        tables,
        lambda name: f"{base}/{run_id}/{name}_cleaned.parquet",
        lambda df, path: replace_folder(df, path, lambda rows, aside: rows.write.parquet(aside)),
    )


def write_csv_backup(tables: Mapping[str, DataFrame], directory: str) -> dict[str, str]:
    """Each non-empty table to the folder `<directory>/<table>.csv`, with a header; a write that fails leaves the earlier copy."""

    def write(df: DataFrame, path: str) -> None:
        options = {"header": True, "quote": '"', "escape": '"', "maxRecordsPerFile": CSV_FILE_ROWS}
        replace_folder(df, path, lambda rows, aside: rows.write.options(**options).csv(aside))

    return _write_nonempty(tables, lambda name: f"{directory}/{name}.csv", write)


def rowcount_validate(spark: SparkSession, namespace: str, table: str, expected: int) -> int:
    return validated(scan_table(spark, namespace, table), expected, f"{namespace}.{table}")


def run_manifest(
    spark: SparkSession, run_id: str, row_counts: Mapping[str, int], paths: Mapping[str, str]
) -> DataFrame:
    """One row per table: run id, table, rows, path of its file copy (null without one)."""
    rows = [(run_id, table, count, paths.get(table)) for table, count in row_counts.items()]
    return spark.createDataFrame(rows, "run_id string, table_name string, row_count bigint, path string")


def record_run(manifest: DataFrame, namespace: str) -> None:
    """Append a manifest to the layer's table of runs, with the time; runs before it stay as they are."""
    spark = manifest.sparkSession
    spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.{RUNS} ({RUN_COLUMNS}) USING parquet LOCATION '{location(spark, namespace)}/{RUNS}'")
    rows = manifest.withColumn("recorded_at", F.current_timestamp())
    rows.coalesce(1).write.insertInto(f"{namespace}.{RUNS}")


def run_history(spark: SparkSession, namespace: str) -> DataFrame:
    """All recorded manifests: run_id, table_name, row_count, path, recorded_at."""
    if not table_exists(spark, namespace, RUNS):
        return spark.createDataFrame([], RUN_COLUMNS)
    return scan_table(spark, namespace, RUNS)


def list_tables(spark: SparkSession, namespace: str) -> DataFrame:
    names = sorted(t.name for t in spark.catalog.listTables(namespace))
    return spark.createDataFrame([(namespace, n) for n in names], "namespace string, table_name string")


def _rank_bits(df: DataFrame, keys: Sequence[str], bits: int) -> list[Column]:
    """For each key the place of a value among 2^bits parts of about equal size; null is in the first."""
    kinds = {c: t for c, t in df.dtypes}

    def number(c: str) -> Column:
        if kinds[c] == "string":  # the first bytes tell the order
            return F.conv(F.rpad(F.substring(F.hex(c), 1, 14), 14, "0"), 16, 10).cast("double")
        if kinds[c] == "date":
            return F.unix_date(c).cast("double")
        if kinds[c].startswith("timestamp"):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.col(c).cast("double")

    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    borders = df.agg(*[F.percentile_approx(number(k), shares, 100 << bits).alias(f"b{i}") for i, k in enumerate(keys)]).first()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def place(value: Column, own: list[float] | None) -> Column:
        limits = F.array(*[F.lit(x) for x in own or [0.0] * len(shares)])
        return F.coalesce(
            F.aggregate(steps, F.lit(0), lambda at, step: F.when(value >= F.element_at(limits, at + step), at + step).otherwise(at)), F.lit(0)
        )

    return [place(number(k), own) for k, own in zip(keys, borders)]


def layout_by_key(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Cluster rows by `keys`, so that file statistics let later filters on any of them skip files.

    One key is clustered by range. Several are by interleaved bits: the parts of about equal size that a
    row's values lie in, 2^b of each key, are numbered, and the bits of these numbers alternate in the
    value that rows are ranged by. So with k keys a filter on a narrow range of one of them meets about
    one in buckets^(1/k) of the files, whichever key it is. The row hash behind the keys lets equal
    rows and keys with very many rows span several partitions.
    """
    spread = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    if len(keys) == 1:
        return df.repartitionByRange(buckets, *keys, spread).sortWithinPartitions(*keys)
    bits = min(8, max(2, buckets.bit_length()))
    places = {f"_place_{i}": p for i, p in enumerate(_rank_bits(df, keys, bits))}
    turns = [
        F.shiftleft(F.shiftright(name, b).bitwiseAND(F.lit(1)).cast("bigint"), b * len(keys) + len(keys) - 1 - i)
        for b in range(bits)
        for i, name in enumerate(places)
    ]
    placed = df.withColumns(places).withColumn("_interleaved", reduce(Column.__add__, turns)).drop(*places)
    return placed.repartitionByRange(buckets, "_interleaved", spread).sortWithinPartitions("_interleaved", *keys).drop("_interleaved")


def file_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file of a stored table: its rows, and the least and largest value of each key, as its statistics have them."""
    limits = [f(k).alias(f"{name}_{k}") for k in keys for f, name in ((F.min, "min"), (F.max, "max"))]
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), *limits)


def files_read(df: DataFrame, key: str, low, high) -> DataFrame:
    """How many files a filter of `key` between two values has to read, of how many."""
    met = (F.col(f"max_{key}") >= low) & (F.col(f"min_{key}") <= high)
    return file_ranges(df, [key]).agg(F.count_if(met).alias("files"), F.count(F.lit(1)).alias("of"))


# Gates: is there anything to do?


def namespace_exists(spark: SparkSession, namespace: str) -> bool:
    return spark.catalog.databaseExists(namespace)


def table_exists(spark: SparkSession, namespace: str, table: str) -> bool:
    return spark.catalog.tableExists(f"{namespace}.{table}")


def table_nonempty(spark: SparkSession, namespace: str, table: str) -> bool:
    return not scan_table(spark, namespace, table).isEmpty()


def needs_refresh(spark: SparkSession, namespace: str, tables: Iterable[str]) -> bool:
    """True at the first sign that the layer, one of its tables, or that table's rows are missing."""
    if not namespace_exists(spark, namespace):
        return True
    return any(
        not table_exists(spark, namespace, t) or not table_nonempty(spark, namespace, t) for t in tables
    )


def needs_extraction(spark: SparkSession, namespace: str = "raw", tables: Iterable[str] = RAW_TABLES) -> bool:
    return needs_refresh(spark, namespace, tables)


def needs_cleaning(
    spark: SparkSession, namespace: str = "cleaned", tables: Iterable[str] = CLEANED_TABLES
) -> bool:
    return needs_refresh(spark, namespace, tables)


def run_if_needed(needed: bool | None, job: Callable):
    """The job's result, or None when there was nothing to do."""
    if needed is None:
        raise ValueError("the gate gave no answer")
    return job() if needed else None


# Contracts: is the input fit for use?


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"essential columns missing: {missing}")
    return df


def require_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is required but empty")
    return df


def default_empty_table(df: DataFrame | None, schema: T.StructType | str, spark: SparkSession | None = None) -> DataFrame:
    """The frame itself, or an empty one of the given schema when there is none."""
    if df is not None:
        return df
    return (spark or SparkSession.active()).createDataFrame([], schema)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself, or an error when some combination of `keys` occurs more than once."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"rows are not unique by {list(keys)}")
    return df
