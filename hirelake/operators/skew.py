"""Left joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HEAVY = 10_000
SKETCH_ITEMS = 65_536
MAX_SALTS = 4_096
_FLOATS = {"double", "float"}
_HASHABLE = {
    "long", "integer", "short", "byte", "string", "date", "boolean", "timestamp", "timestamp_ntz", "decimal", *_FLOATS,
}


@dataclass(frozen=True)
class HeavyKeys:
    """Hashes of the key values worth splitting, by the number of salts each is split into."""

    tiers: Mapping[int, tuple[int, ...]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.tiers)

    def salts(self, keys: Sequence[str | Column]) -> Column:
        """Number of salts of a row's key, 1 for a key that is not heavy."""
        key_hash, salts = F.xxhash64(*keys), F.lit(1).cast("bigint")
        for count, hashes in self.tiers.items():
            salts = F.when(key_hash.isin(*hashes), F.lit(count).cast("bigint")).otherwise(salts)
        return salts


def heavy_keys(
    df: DataFrame, key_sets: Mapping[str, Sequence[str]], share: float | None = None, least: int | None = None
) -> dict[str, HeavyKeys]:
    """Find, in one pass and without a shuffle of rows, the keys with more than their share of rows.

    The answer comes from a mergeable frequent-items sketch of bounded size. It steers only the
    layout of a join: a key missed or listed by mistake changes no result. The default share is
    twice an average shuffle partition; `least` asks for keys with more rows than that instead. A key gets about as many salts, rounded up to a power of
    two, as average partitions would hold its rows.
    """
    names = [n for n, keys in key_sets.items() if _can_hash(df, keys)]
    found = {n: HeavyKeys() for n in key_sets}
    if not names:
        return found
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    partitions = int(setting) if setting.isdigit() else df.sparkSession.sparkContext.defaultParallelism
    share = share or max(2 / partitions, 1 / MAX_HEAVY)
    hashed = df.select(*[F.xxhash64(*key_sets[n]).alias(f"h{i}") for i, n in enumerate(names)])
    sketches = [
        F.call_function("approx_top_k", F.col(f"h{i}"), F.lit(MAX_HEAVY), F.lit(SKETCH_ITEMS))
        for i in range(len(names))
    ]
    total, *tops = hashed.agg(F.count(F.lit(1)), *sketches).first()
    for name, top in zip(names, tops):
        tiers: dict[int, tuple[int, ...]] = {}
        for key_hash, count in top or ():
            if count > (share * total if least is None else least):
                average_partitions = max(2, math.ceil(count / total * partitions))
                salts = min(MAX_SALTS, 1 << (average_partitions - 1).bit_length())
                tiers[salts] = (*tiers.get(salts, ()), key_hash)
        found[name] = HeavyKeys(tiers)
    return found


def _can_hash(df: DataFrame, keys: Sequence[str]) -> bool:
    return all(df.schema[k].dataType.typeName() in _HASHABLE for k in keys)


def left_join_default(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    defaults: Mapping[str, object] | None = None,
    null_safe: bool = True,
    heavy: HeavyKeys | None = None,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Left equi-join that keeps one copy of the keys and fills nulls of the right side's columns.

    With `heavy` keys the left rows of such a key are spread over several salts by a hash of
    `salt_by` (all left columns by default), and only the right rows of such keys are repeated,
    once per salt. The salt depends on row content alone, so a rerun task places rows the same.
    The choice between broadcast and shuffle is left to Spark, which knows the sizes.
    """
    keys = list(keys)
    added = [c for c in right.columns if c not in keys]
    clash = set(added) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    pairs = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(pairs)
    if heavy:
        # Hashed as the left side's type, in which the heavy keys were found.
        as_left = [F.col(pairs[k]).try_cast(left.schema[k].dataType) for k in keys]
        salt = F.pmod(F.xxhash64(*(salt_by or left.columns)), heavy.salts(keys))
        left = left.withColumn("_salt", F.when(heavy.salts(keys) > 1, salt).otherwise(F.lit(0)))
        every = F.sequence(F.lit(0).cast("bigint"), heavy.salts(as_left) - 1)
        other = other.withColumn("_right_salt", F.explode(every))
        pairs["_salt"] = "_right_salt"
    equal = [
        F.col(a).eqNullSafe(F.col(b)) if null_safe and a != "_salt" else F.col(a) == F.col(b)
        for a, b in pairs.items()
    ]
    joined = left.join(other, reduce(Column.__and__, equal), "left").drop(*pairs.values(), "_salt")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}
    return joined.withColumns(filled) if filled else joined
