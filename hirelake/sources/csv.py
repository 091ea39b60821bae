"""CSV files to typed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.fixed_values import NA_TOKENS
from hirelake.functions.values import to_double
from hirelake.sources.split_csv import read_records

SEQ = "_seq"
WHOLE_FILE_LIMIT = 1 << 30


def na_tokens_to_null(df: DataFrame, tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Text that is exactly one of `tokens` becomes null, in every text column."""
    tokens = list(tokens)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in text})


def _typed(c: str, data_type: T.DataType) -> Column:
    text = F.col(c)
    if isinstance(data_type, T.StringType):
        return text
    if isinstance(data_type, T.DoubleType):
        return to_double(text)
    if isinstance(data_type, T.LongType):
        # The reader of a whole-number column may meet 12 and 12.0 alike.
        return F.coalesce(text.try_cast("bigint"), to_double(text).try_cast("bigint"))
    return text.try_cast(data_type)


def cast_by_schema(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Cast text columns by name; names the schema lacks stay text, bad values become null."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = {f.name: f.dataType for f in schema.fields}
    return df.withColumns({c: _typed(c, t) for c, t in wanted.items() if c in df.columns})


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """Path and size of the files at `path`, from the listing alone; None when there is no such path."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _mode(spark: SparkSession, path: str) -> str:
    files = _files(spark, path)
    large = files is not None and not files.filter(F.col("length") > WHOLE_FILE_LIMIT).isEmpty()
    return "split" if large else "whole"


def _from_records(records: DataFrame, names: list[str], header: list[str | None]) -> DataFrame:
    """Parse the text of records; a file with another header than the given one fails the read.

    A comma ends the last field as a line break does in a file: at the end of a text the parser adds
    a quote to a field that has text after its closing quote. The empty field behind it goes. A field
    that is open at the end of the file ends there.
    """
    ddl = ", ".join("`{}` string".format(c.replace("`", "``")) for c in names)
    options = {"multiLine": "true", "quote": '"', "escape": '"', "lineSep": "\n"}
    place = F.struct("file", "block", F.col("record").alias("row"))
    ended = F.concat("text", F.when(F.col("open"), F.lit("")).otherwise(F.lit(",")))
    rows = records.select("record", F.from_csv(ended, F.lit(ddl), options).alias("_row"), place.alias(SEQ))
    found = F.array(*[F.col("_row").getField(c) for c in names])
    wanted = F.array(*[F.lit(c).cast("string") for c in header])
    problem = F.concat(F.lit("header differs from that of the other files: "), F.col(f"{SEQ}.file"))
    skipped = F.when(found.eqNullSafe(wanted), F.lit(False)).otherwise(F.raise_error(problem).cast("boolean"))
    return rows.filter(F.when(F.col("record") == -2, skipped).otherwise(True)).select("_row.*", SEQ)


def read_csv(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """A CSV file, or a folder of them, as text columns plus `_seq`, the row's place in the input.

    All files of a folder must have the header of the first, or reading fails. `mode` says how
    line breaks in quoted fields are dealt with: `whole` reads each file in one task; `split` cuts
    files of any size at records, with the same rows; `auto` splits when some file is larger than
    1 GiB, which changes the time only; `lines` is for files without such breaks.
    """
    mode = _mode(spark, path) if mode == "auto" else mode
    options = {"multiLine": mode != "lines", "quote": '"', "escape": '"'}
    df = spark.read.options(header=True, **options).csv(path)
    if mode == "split":
        header = spark.read.options(**options).csv(path).first()
        return _from_records(read_records(spark, path), df.columns, list(header or []))
    if len(df.inputFiles()) > 1:
        df = spark.read.options(header=True, enforceSchema=False, **options).schema(df.schema).csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn(SEQ, place)


def require_files(spark: SparkSession, paths: Mapping[str, str], strict: bool = True) -> dict[str, str]:
    """Those of `paths` that exist; `strict` raises on the first that does not."""
    present = {}
    for table, path in paths.items():
        if _files(spark, path) is not None:
            present[table] = path
        elif strict:
            raise FileNotFoundError(f"no CSV for table {table}: {path}")
    return present


def read_csv_tables(
    spark: SparkSession,
    paths: Mapping[str, str],
    schemas: Mapping[str, T.StructType | str] | None = None,
    na_tokens: Iterable[str] = NA_TOKENS,
    strict: bool = True,
    mode: str = "auto",
) -> dict[str, DataFrame]:
    """Table name to typed frame with a `_seq` column for the row order of the files."""
    tables = {}
    for table, path in require_files(spark, paths, strict).items():
        df = na_tokens_to_null(read_csv(spark, path, mode), na_tokens)
        tables[table] = cast_by_schema(df, schemas[table]) if schemas and table in schemas else df
    return tables
