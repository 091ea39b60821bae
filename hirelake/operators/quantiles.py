"""Exact quantiles, and the two repairs built on them: outlier capping and median filling.

A quantile needs one or two values at known ranks. One pass makes a KLL sketch of every column, whose
rank error is stated, and takes a bracket of two values around each rank from it. A second pass counts
all values against all brackets and gathers those inside, which decides the ranks exactly: two passes for any
number of columns, as long as the values that the stated error leaves in the brackets are few enough to sort in
one row. Beyond that, or where a sketch was worse than stated, the ranks that are left are found by narrowing: a mergeable
sketch proposes two values around each rank, one counting pass decides exactly which piece
holds the rank, and this repeats until all pieces of a call are small enough to sort together. No pass shuffles
rows, and the exactness does not hang on any sketch, only the number of passes does.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hirelake.fixed_values import IQR_FACTOR, UNKNOWN
from hirelake.functions.money import clip_upper_const
from hirelake.functions.values import doubles, to_double

SORT_LIMIT = 200_000
SKETCH_ACCURACY = 10_000
SKETCH_PARTS = 64  # sketches of many tasks are merged in so many places first
_LARGEST_SKETCH = 16_384


@dataclass(frozen=True)
class _Piece:
    """An open interval of values of one column; `base` values lie at or below `low`."""

    col: str
    low: float | None
    high: float | None
    base: int
    size: int

    def values(self) -> Column:
        value = F.col(self.col)
        if self.low is not None:
            value = F.when(F.col(self.col) > self.low, value)
        if self.high is not None:
            value = F.when(F.col(self.col) < self.high, value)
        return value


Targets = dict[tuple[str, int], _Piece]


def _one_row(df: DataFrame, exprs: list) -> list:
    return list(df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def _around(shares: Iterable[float], accuracy: int) -> list[float]:
    """Shares just below and above each given one, by twice the sketch's error."""
    return sorted({min(1.0, max(0.0, s + shift / accuracy)) for s in shares for shift in (-2, 2)})


def _pivots(df: DataFrame, ranks: dict[_Piece, set[int]], accuracy: int) -> dict[_Piece, list[float]]:
    """Values of each piece that a sketch puts closely around the wanted ranks."""
    sketches = [
        F.percentile_approx(p.values(), _around([(r - p.base) / p.size for r in ranks[p]], accuracy), accuracy)
        for p in ranks
    ]
    return dict(zip(ranks, _one_row(df, sketches)))


def _narrow(
    df: DataFrame, wanted: Targets, sort_limit: int, accuracy: int, found: dict, known: dict[_Piece, list[float]]
) -> Targets:
    """Shrink the piece of every wanted (column, rank); ranks that fall on a pivot are found.

    A pivot is a value of its piece and belongs to none of the new pieces, so each pass shrinks them.
    """
    pieces = set(wanted.values())
    ranks: dict[_Piece, set[int]] = {}
    for (_, rank), piece in wanted.items():
        if piece.size > max(1, sort_limit // len(pieces)):
            ranks.setdefault(piece, set()).add(rank)
    unknown = {p: r for p, r in ranks.items() if p not in known}
    pivots = known | (_pivots(df, unknown, accuracy) if unknown else {})
    pivots = {p: sorted(set(pivots[p])) for p in ranks}
    tests = [t for p in ranks for x in pivots[p] for t in (p.values() < x, p.values() <= x)]
    counted = iter(_one_row(df, [F.count_if(t) for t in tests]))
    borders = {p: [(x, p.base + next(counted), p.base + next(counted)) for x in pivots[p]] for p in ranks}
    narrowed = {}
    for target, piece in wanted.items():
        if piece not in ranks:
            narrowed[target] = piece
            continue
        low, base = piece.low, piece.base
        for value, below, upto in [*borders[piece], (piece.high, piece.base + piece.size, None)]:
            if target[1] < below:
                narrowed[target] = _Piece(piece.col, low, value, base, below - base)
                break
            if target[1] < upto:
                found[target] = value
                break
            low, base = value, upto
    return narrowed


def _values_at_ranks(
    df: DataFrame, wanted: Targets, sort_limit: int, accuracy: int, known: dict[_Piece, list[float]]
) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    while sum(p.size for p in set(wanted.values())) > max(sort_limit, len(set(wanted.values()))):
        wanted = _narrow(df, wanted, sort_limit, accuracy, found, known)
    if wanted:
        # All pieces together hold at most `sort_limit` values, or one each, so the row is bounded.
        pieces = list(dict.fromkeys(wanted.values()))
        lists = df.agg(
            *[F.sort_array(F.collect_list(p.values())).alias(f"v{i}") for i, p in enumerate(pieces)]
        )
        picks = [F.get(f"v{pieces.index(p)}", F.lit(rank - p.base)) for (_, rank), p in wanted.items()]
        found.update(zip(wanted, lists.select(*[x.alias(f"t{i}") for i, x in enumerate(picks)]).first()))
    return found


def _between(low: float, high: float, t: float) -> float:
    return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)


def _rank_error(k: int) -> float:
    """Share of the values by which a rank of a KLL sketch of size k is off, at 99 in 100."""
    return 2.296 / k**0.9021


def _sketches(df: DataFrame, cols: Sequence[str], qs: Sequence[float], k: int) -> dict[str, tuple[int, dict[float, tuple[float, float]]]]:
    """Values of each column, and a bracket around each of its quantiles.

    Each task sketches all columns. Where shuffles have more partitions than `SKETCH_PARTS`, sketches meet
    in that many groups first, so no task merges those of all others.
    """
    names = [f"s{i}" for i in range(len(cols))]
    sketches = [F.kll_sketch_agg_double(c, F.lit(k)).alias(n) for c, n in zip(cols, names)]
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    if setting.isdigit() and int(setting) > SKETCH_PARTS:
        part = F.pmod(F.spark_partition_id(), F.lit(SKETCH_PARTS))
        each = df.select(*cols, part.alias("_part")).groupBy("_part").agg(*sketches)
        whole = each.agg(*[F.kll_merge_agg_double(n, F.lit(k)).alias(n) for n in names])
    else:
        whole = df.agg(*sketches)
    shares = {q: (max(0.0, q - 2 * _rank_error(k)), min(1.0, q + 2 * _rank_error(k))) for q in qs}
    at = F.array(*[F.lit(s) for q in qs for s in shares[q]])

    def figures(n: str) -> list[Column]:
        count = F.coalesce(F.kll_sketch_get_n_double(n), F.lit(0))
        return [count.alias(f"n_{n}"), F.when(count > 0, F.kll_sketch_get_quantile_double(n, at)).alias(f"q_{n}")]

    row = whole.select(*[f for n in names for f in figures(n)]).first()
    found = {}
    for c, count, values in zip(cols, row[::2], row[1::2]):
        found[c] = count, dict(zip(qs, zip(values[::2], values[1::2]))) if count else {}
    return found


def _bracketed(df: DataFrame, brackets: dict[tuple[str, float], tuple[float, float]], extra: list[Column]) -> tuple[dict, list]:
    """For each bracket a function from a rank to its value, None where the bracket misses it; and the row of `extra`."""
    exprs = []
    for (c, _), (low, high) in brackets.items():
        value = F.col(c)
        inner = F.sort_array(F.collect_list(F.when((value > low) & (value < high), value)))
        exprs += [F.count_if(value < low), F.count_if(value <= low), F.count_if(value < high), F.count_if(value <= high), inner]
    row = _one_row(df, [*extra, *exprs])
    counted = row[len(extra) :]

    def lookup(i: int, low: float, high: float):
        below, upto, inside, through, values = counted[5 * i : 5 * i + 5]

        def at(rank: int) -> float | None:
            if not below <= rank < through:
                return None
            return low if rank < upto else high if rank >= inside else values[rank - upto]

        return at

    return {key: lookup(i, *pair) for i, (key, pair) in enumerate(brackets.items())}, row[: len(extra)]


def quantiles_and(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    extra: Sequence[Column] = (),
    sort_limit: int = SORT_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
) -> tuple[dict[str, list[float | None]], list]:
    """Exact quantiles of columns of doubles, and the values of `extra` aggregates, which ride on the second pass."""
    cols, extra, qs = list(cols), list(extra), list(qs)
    if not cols:
        return {}, _one_row(df, extra) if extra else []
    k = max(8, min(accuracy, _LARGEST_SKETCH))
    sketched = _sketches(df, cols, qs, k)
    counts = {c: n for c, (n, _) in sketched.items()}
    position = {(c, q): q * (counts[c] - 1) for c in cols if counts[c] for q in qs}
    ranks = {key: {math.floor(p), math.ceil(p)} for key, p in position.items()}
    brackets = {(c, q): sketched[c][1][q] for c, q in position}
    inside = sum(4 * _rank_error(k) * counts[c] for c, _ in brackets)
    found: dict[tuple[str, int], float] = {}
    figures: list = []
    if brackets and inside <= sort_limit:
        lookups, figures = _bracketed(df, brackets, extra)
        values = {(key[0], r): lookups[key](r) for key in ranks for r in ranks[key]}
        found = {target: v for target, v in values.items() if v is not None}
    elif extra:
        figures = _one_row(df, extra)
    whole = {c: _Piece(c, None, None, 0, counts[c]) for c in cols}
    left = {(c, r): whole[c] for (c, _), own in ranks.items() for r in own if (c, r) not in found}
    if left:
        known = {whole[c]: [v for q in qs for v in sketched[c][1][q]] for c in {c for c, _ in left}}
        found |= _values_at_ranks(df, left, sort_limit, accuracy, known)

    def quantile(c: str, q: float) -> float | None:
        if not counts[c]:
            return None
        p = position[c, q]
        return _between(found[c, math.floor(p)], found[c, math.ceil(p)], p - math.floor(p))

    return {c: [quantile(c, q) for q in qs] for c in cols}, figures


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    sort_limit: int = SORT_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; nulls and NaN are ignored, no values give None."""
    return quantiles_and(doubles(df, cols), cols, qs, (), sort_limit, accuracy)[0]


def quantiles_exact(df: DataFrame, col: str, qs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """One row per quantile: q, value."""
    values = exact_quantiles(df, [col], qs)[col]
    return df.sparkSession.createDataFrame(list(zip(qs, values)), "q double, value double")


def all_null_check(df: DataFrame, col: str) -> DataFrame:
    return df.agg((F.count(col) == 0).alias("all_null"), F.count(col).alias("values"))


def upper_caps(
    df: DataFrame, cols: Sequence[str], k: float = IQR_FACTOR, approx: int | None = None
) -> dict[str, float | None]:
    """Third quartile plus `k` interquartile ranges per column; None for a column without values."""
    if approx:
        sketches = _one_row(df, [F.percentile_approx(to_double(c), [0.25, 0.75], approx) for c in cols])
        quartiles = {c: s or (None, None) for c, s in zip(cols, sketches)}
    else:
        quartiles = exact_quantiles(df, cols, (0.25, 0.75))
    return {c: None if q1 is None else q3 + k * (q3 - q1) for c, (q1, q3) in quartiles.items()}


def iqr_cap(
    df: DataFrame, cols: Sequence[str], k: float = IQR_FACTOR, approx: int | None = None
) -> DataFrame:
    """Cap the upper side of each column on its own; `approx` trades exactness for one pass."""
    caps = upper_caps(df, cols, k, approx)
    return df.withColumns({c: clip_upper_const(c, cap) for c, cap in caps.items()})


def median_impute(df: DataFrame, col: str, default: float = 0) -> DataFrame:
    """Nulls become the column's median, cut to a whole number; a text column gets `Unknown`."""
    if not isinstance(df.schema[col].dataType, NumericType):
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(UNKNOWN)))
    (median,) = exact_quantiles(df, [col], [0.5])[col]
    filled = F.coalesce(to_double(col), F.lit(float(default if median is None else median)))
    return df.withColumn(col, filled.cast("bigint"))
