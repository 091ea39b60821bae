"""Operators whose result depends on row order. All take a total order; none sorts in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirelake.operators.skew import HeavyKeys, heavy_keys, left_join_default
from hirelake.sources.csv import SEQ
from hirelake.sources.staging import stage

LIST_LIMIT = 100_000
BROADCAST_ROWS = 1_000_000
_FIXED_WIDTH = (
    "long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz",
)


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row of every key, by aggregation.

    The winner of each key is already known per input partition before the shuffle, so a key
    that holds most of the rows costs no more than any other. Null keys form one group.
    """
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    groups = df.groupBy(*keys)
    if len(order_by) == 1 and all(types[c] in _FIXED_WIDTH for c in (*rest, *order_by)):
        # Fixed-width buffers keep this a hash aggregate; the order column must not be null.
        order = F.col(order_by[0])
        return groups.agg(*[pick(c, order).alias(c) for c in rest]).select(*df.columns)
    winner = pick(F.struct(*rest), F.struct(*order_by)).alias("_row")
    return groups.agg(winner).select(*keys, "_row.*").select(*df.columns)


def sequential_id(df: DataFrame, order_by: Sequence[str], names: Sequence[str] = ("seq",)) -> DataFrame:
    """Number the rows 1..n along `order_by`, a total order, and put the number in each of `names`.

    In file order a row is numbered by its place in its file split plus the rows of all earlier
    splits, without moving any row. For any other order the rows are range-partitioned, sorted
    and staged, and the sorted blocks take the role of the splits. Rows that are equal in `order_by` are
    ordered by a hash of the whole row, then by the input partition they come from, so that many of
    them span several blocks, be they equal in every column or not.
    """
    if list(order_by) == [SEQ] and isinstance(df.schema[SEQ].dataType, StructType):
        # Staged, since every pass over the numbered rows asks for them.
        runs = stage(_file_runs(df), "runs")
        count, whole = _run_figures(runs)
        if whole:
            keys = {"file": "_seq.file", "block": "_seq.block"}
            return _numbered(df, runs, keys, "_seq.row", names, broadcast=count <= BROADCAST_ROWS)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    content = [c for c, t in df.dtypes if "map<" not in t]
    # A partition id stays the same when a lost task runs again, as do the rows of its partition.
    told = df.withColumns({"_tie": F.xxhash64(*content), "_from": F.spark_partition_id()})
    whole_order = [*order_by, "_tie", "_from"]
    placed = (
        told.repartitionByRange(*whole_order)
        .sortWithinPartitions(*whole_order)
        .drop("_tie", "_from")
        .withColumns({"_block": F.spark_partition_id(), "_place": place})
    )
    staged = stage(placed, "numbered")
    runs = staged.groupBy("_block").agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("rows"))
    # At most one block per shuffle partition, so always small.
    return _numbered(staged, runs, {"_block": "_block"}, "_place", names, broadcast=True).drop("_block", "_place")


def _file_runs(df: DataFrame) -> DataFrame:
    """First and last row and row count per file split."""
    place = F.col("_seq.row")
    return df.groupBy(F.col("_seq.file").alias("file"), F.col("_seq.block").alias("block")).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows")
    )


def _run_figures(runs: DataFrame) -> tuple[int, bool]:
    """The number of file splits, and whether each is without gaps."""
    gap = F.col("last") - F.col("first") + 1 != F.col("rows")
    count, gaps = runs.agg(F.count(F.lit(1)), F.count_if(gap)).first()
    return count, gaps == 0


def _numbered(
    df: DataFrame, runs: DataFrame, keys: Mapping[str, str], place: str, names: Sequence[str], broadcast: bool
) -> DataFrame:
    """Row numbers from `runs`, which has one short row per input split or sorted block.

    The driver plans each of them as a task, so one window can add them up.
    """
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first") + 1
    shifts = runs.select(*[F.col(k).alias(f"_run_{k}") for k in keys], shift.alias("_shift"))
    same_run = [F.col(path) == F.col(f"_run_{k}") for k, path in keys.items()]
    joined = df.join(F.broadcast(shifts) if broadcast else shifts, same_run, "left")
    number = F.col(place) + F.col("_shift")
    return joined.withColumns({n: number for n in names}).drop("_shift", *[f"_run_{k}" for k in keys])


def collect_list_by_key(
    df: DataFrame, key: str, col: str, order_by: Sequence[str], max_items: int = LIST_LIMIT
) -> DataFrame:
    """Ordered lists of `col`: columns key, `col`, `_part`. Null items stay, null keys go.

    A row is one part of a key's list: parts have `max_items` items, the last one the rest, and
    are numbered from 0. That holds at all sizes. Keys that a sketch finds to be long are numbered
    by a range sort first, so no task needs to hold their whole lists; all other keys are
    gathered at once. A key the sketch missed only takes more memory.
    """
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key), F.col(col).alias("_item"), *[F.col(c).alias(f"_order_{i}") for i, c in enumerate(order_by)]
    )
    orders = [f"_order_{i}" for i in range(len(order_by))]
    items = F.sort_array(F.collect_list(F.struct(*orders, "_item"))).alias("_sorted")
    long = heavy_keys(rows, {"key": [key]}, least=max_items)["key"]
    parts = _plain_lists(rows.filter(long.salts([key]) == 1) if long else rows, key, items, max_items)
    if long:
        parts = parts.unionByName(_numbered_lists(rows.filter(long.salts([key]) > 1), key, orders, items, max_items, long))
    return parts.select(key, F.col("_sorted._item").alias(col), "_part")


def _plain_lists(rows: DataFrame, key: str, items: Column, max_items: int) -> DataFrame:
    whole = rows.groupBy(key).agg(items)
    starts = F.sequence(F.lit(0), F.floor((F.size("_sorted") - 1) / max_items).cast("int"))
    part = F.slice("_sorted", F.col("_part") * max_items + 1, F.lit(max_items))
    return whole.withColumn("_part", F.explode(starts)).withColumn("_sorted", part)


def _numbered_lists(
    rows: DataFrame, key: str, orders: Sequence[str], items: Column, max_items: int, long: HeavyKeys
) -> DataFrame:
    numbered = sequential_id(rows, [key, *orders], ["_number"])
    starts = numbered.groupBy(key).agg(F.min("_number").alias("_first"))
    placed = left_join_default(numbered, starts, [key], heavy=long, salt_by=["_number"])
    part = F.floor((F.col("_number") - F.col("_first")) / max_items).cast("int")
    return placed.withColumn("_part", part).groupBy(key, "_part").agg(items)
