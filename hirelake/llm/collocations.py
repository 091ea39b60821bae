"""Collocations: phrases scored by how much more often their words occur together than their parts do.

Candidates are found by SON partitioning. Documents are dealt into `SHARDS` shards by a hash of their
text. With w of a label's W words, a shard mines its phrases completely at the support
ceil(support * w / W); a phrase that occurs `support` times reaches this in one shard at least, so the
union of what the shards find misses none. A shard is mined level by level: words, then pairs of words
that reached the support in this shard, then phrases all of whose pairs did. Up to here phrases are 64-bit
hashes; two that meet in one hash only add candidates. The phrases of the union are then counted exactly over all
documents, told apart by 96 bits: among n candidates two are taken for one with a probability of about
n^2 / 2^97. A last pass reads the text of each phrase that is often enough in one document that holds it.

A shard is not a task: its counts come from all tasks that read its documents. With many shards the
local support would fall to 1 and nothing would be pruned, hence few of them. Tasks count a few million
phrases at a time and hand on sorted runs of hashes with counts, dealt by their leading bits, so Spark moves few
rows and a phrase, however common, is one entry of each run. What a level or the union found goes to tasks as a bit
table of fixed size (a Bloom filter of `FILTER_BITS`); a fuller one prunes less and changes no count.

Defined results: a null text counts as empty, a null label as `und`; doc_id is not read, so repeated
rows, ties and null ids each count; further columns are not read; an empty table gives no row. Long
texts are cut into slices of a few million bytes that overlap by the words a phrase may reach back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.operators.skew import heavy_keys, left_join_default
from hirelake.sources.staging import stage

LONGEST = 4
SUPPORT = 30
SHARDS = 8
FILTER_BITS = 1 << 26
TOP = 2000
SCALE = 2_000_000
SLICE_BYTES = 1_000_000
COUNTED_AT_ONCE = 1_000_000  # phrases
BROADCAST_CELLS = 100_000
TOP_PARTS = 16
BLOCKS_A_PARTITION = 2
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so each has an inverse
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE, _END = 254, 255  # no bytes of any text in UTF-8
_TO = np.frombuffer(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ \t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + bytes([_SPACE] * 2 + [_END] * 10)),
    np.uint8,
)
_RUNS = "block int, cells binary, grams binary, checks binary, owners binary, n binary"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FIRST
    return x ^ (x >> np.uint64(29))


def _powers_of(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < size:
        steps = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        _powers[base] = tuple(np.multiply.accumulate(x) for x in steps)
    return _powers[base]


class _Slice:
    """The words of some texts side by side: where they are, whose they are, and which stand in one piece.

    `raw` holds lower-cased bytes, with a mark for each kind of separator. Words that begin before `fresh` were part of the slice
    before; a phrase counts where its last word is new.
    """

    def __init__(self, raw: np.ndarray, begins: np.ndarray, fresh: int):
        size = len(raw)
        inner = (raw != _SPACE) & (raw != _END)
        border = np.zeros(size + 1, bool)
        border[begins] = border[0] = border[size] = True
        before = np.concatenate(([False], inner))
        after = np.concatenate((inner, [False]))
        self.starts = np.flatnonzero(after & (~before | border))
        self.ends = np.flatnonzero(before & (~after | border))
        self._raw = raw
        self.text = np.searchsorted(begins, self.starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(raw == _END), self.starts)
        self.linked = (np.diff(piece) == 0) & (np.diff(self.text) == 0)
        self.new = self.starts >= fresh

    def hashes(self, base: int) -> np.ndarray:
        """A hash of each word: its bytes as digits from 1 on, moved to one place."""
        up, down = _powers_of(base, len(self._raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self._raw.astype(np.uint64) + np.uint64(1)) * up[: len(self._raw)], dtype=np.uint64)))
        return _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def words(self, first: int, last: int) -> str:
        """The words from one to another, joined by single spaces."""
        return " ".join(self._raw[self.starts[i] : self.ends[i]].tobytes().decode() for i in range(first, last + 1))


def _slices(texts: pa.StringArray, longest: int, size: int) -> Iterator[tuple[_Slice, np.ndarray]]:
    """All texts, about `size` bytes at a time, and the rows that a slice's texts have."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        start, stop = int(ends[row]), int(ends[last])
        if last > row + 1 or stop - start <= size:
            if stop > start:
                yield _Slice(_TO[raw[start:stop]], ends[row:last] - start, 0), np.arange(row, last)
            row = last
            continue
        fresh = start
        while fresh < stop:
            cut = min(stop, fresh + size)
            while cut < stop:
                gaps = np.flatnonzero(np.isin(_TO[raw[fresh + 1 : cut]], (_SPACE, _END)))
                if len(gaps):
                    cut = fresh + 1 + int(gaps[-1])
                    break
                cut = min(stop, cut + size)
            some = _Slice(_TO[raw[start:cut]], np.zeros(1, np.int64), fresh - start)
            yield some, np.array([row])
            back = some.starts[max(0, len(some.starts) - longest + 1) :]
            start, fresh = (start + int(back[0]) if len(back) and longest > 1 else cut), cut
        row = last


class _Bits:
    """A bit table in a task; a value may be in it if both its bits are set."""

    def __init__(self, table: np.ndarray):
        self._table, self._last = table, np.uint64(len(table) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in (hashes & self._last, hashes >> np.uint64(32) & self._last):
            found &= (self._table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _phrases(some: _Slice, words: np.ndarray, keys: np.ndarray, longest: int, filters: dict[int, _Bits], salt: np.ndarray):
    """length, hash of the phrase of that length at each word, and whether there is one that stands.

    Phrases of k words pass the filter for k, if there is one; a longer one needs both its shorter ones to stand.
    """
    gram, stands = _mixed(words ^ keys), np.ones(len(words), bool)
    for length in range(1, longest + 1):
        if length > 1:
            gram = _mixed(gram[:-1]) * _SECOND + words[length - 1 :]
            stands = stands[:-1] & stands[1:] & (some.linked if length == 2 else True)
        if length in filters:
            at = np.flatnonzero(stands)
            stands[at] = filters[length].has(gram[at] ^ salt[at])
        yield length, gram, stands


def _salt(shard):
    """What sets a phrase's hash in one shard apart from that in another; the same for arrays and columns."""
    return shard * 0x9E3779B1


def _distinct(columns: list[np.ndarray], order: np.ndarray) -> list[np.ndarray]:
    """Hashes in the given order without repeats (grams, checks), their least owners and their summed counts."""
    grams, checks, owners, n = (c[order] for c in columns)
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (checks[1:] != checks[:-1])))
    starts = np.flatnonzero(new)
    return [grams[starts], checks[starts], np.minimum.reduceat(owners, starts), np.add.reduceat(n, starts)]


def _runs(cells: list[tuple], cell: np.ndarray, columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """One row for each value of the leading `bits`: its hashes with their counts, sorted within each cell."""
    order = np.argsort(cell.astype(np.uint16) if len(cells) < 1 << 16 else cell, kind="stable")
    borders = np.searchsorted(cell[order], np.arange(len(cells) + 1))
    parts = []
    for i, (first, last) in enumerate(zip(borders, borders[1:])):
        if first < last:
            own = order[first:last]
            found = _distinct(columns, own[np.argsort(columns[0][own])])
            parts.append([np.full(len(found[0]), i), *found])
    which, grams, checks, owners, n = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 5
    block = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    order = np.argsort(block.astype(np.uint16) if bits <= 16 else block, kind="stable")
    borders = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
    rows = []
    for a, b in zip(borders, borders[1:]):
        own = order[a:b]
        in_block, sizes = np.unique(which[own], return_counts=True)
        told = np.array([(*cells[i], size) for i, size in zip(in_block, sizes)], np.int64)
        values = (told, grams[own], checks[own], owners[own], n[own].astype(np.uint32))
        rows.append((int(block[own[0]]), *(v.tobytes() for v in values)))
    types = [pa.int32(), *[pa.binary()] * 5]
    made = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, types)], [f.split()[0] for f in _RUNS.split(", ")])


def _count_runs(docs: DataFrame, lengths: range, filters: dict[int, Broadcast], bits: int, size: int, told: bool = False) -> DataFrame:
    """Runs of the phrases of `lengths` whose shorter ones pass the filters.

    `docs` has key, shard, least (the support that counts in this cell), owner and text; `told` also gives each phrase its
    check, 32 more bits of its hash, and the least owner of the documents that hold it.
    """

    def run(batches):
        tables = {k: _Bits(f.value) for k, f in filters.items()}
        cells: dict[tuple, int] = {}
        parts, kept = [], 0

        def made():
            cell, *columns = map(np.concatenate, zip(*parts))
            return _runs(list(cells), cell, [*columns, np.ones(len(cell), np.int64)], bits)

        for batch in batches:
            tuples = zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "least")))
            cell_of = np.array([cells.setdefault(t, len(cells)) for t in tuples], np.int64)
            owner_of = batch.column("owner").to_numpy().astype(np.uint32)
            key_of = batch.column("key").to_numpy().view(np.uint64)
            salt_of = _salt(batch.column("shard").to_numpy().astype(np.int64)).view(np.uint64)
            for some, rows in _slices(batch.column("text"), lengths[-1], size):
                row = rows[some.text]
                found = _phrases(some, some.hashes(_BASES[0]), key_of[row], lengths[-1], tables, salt_of[row])
                second = some.hashes(_BASES[1]) if told else None
                checks = _phrases(some, second, key_of[row], lengths[-1], {}, second) if told else None
                for length, gram, stands in found:
                    check = next(checks)[1] if told else None
                    if length in lengths:
                        at = np.flatnonzero(stands & some.new[length - 1 :])
                        more = ((check[at] >> np.uint64(32)).astype(np.uint32), owner_of[row[at]]) if told else [np.zeros(len(at), np.uint32)] * 2
                        parts.append((cell_of[row[at]], gram[at], *more))
                        kept += len(at)
                if kept >= COUNTED_AT_ONCE:
                    yield made()
                    cells, parts, kept = dict(cells), [], 0
        if parts:
            yield made()

    return docs.select("key", "shard", "least", "owner", "text").mapInArrow(run, _RUNS)


def _summed(runs: DataFrame) -> DataFrame:
    """key, shard, gram, check, owner, n of all runs together, where n reaches the cell's `least`."""

    def total(cells):
        for (key, shard, least), parts in cells.items():
            columns = [np.concatenate(c) for c in zip(*parts)]
            found = _distinct(columns, np.lexsort((columns[1], columns[0])))
            grams, checks, owners, n = (c[found[3] >= least] for c in found)
            same = [np.full(len(n), key), np.full(len(n), shard, np.int32)]
            arrays = [*same, grams.view(np.int64), checks.view(np.int32), owners.view(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["key", "shard", "gram", "check", "owner", "n"])

    def run(batches):
        block, cells = None, {}
        for batch in batches:
            for own, told, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                if own != block:
                    yield from total(cells)
                    block, cells = own, {}
                kinds = (np.uint64, np.uint32, np.uint32, np.uint32)
                grams, checks, owners, n = (np.frombuffer(c, k) for c, k in zip(columns, kinds))
                first = 0
                for key, shard, least, size in np.frombuffer(told, np.int64).reshape(-1, 4).tolist():
                    part = slice(first, first + size)
                    cells.setdefault((key, shard, least), []).append((grams[part], checks[part], owners[part], n[part].astype(np.int64)))
                    first += size
        yield from total(cells)

    dealt = runs.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "key long, shard int, gram long, check int, owner int, n long")


def _bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of all values of the column `hash`: at most bits / 64 rows reach the driver."""
    at = F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1))
    rows = hashes.select(F.explode(at).alias("at")).select(
        F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("set")
    )
    words = rows.groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return table


def _block_bits(docs: DataFrame) -> int:
    setting = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    partitions = int(setting) if setting.isdigit() else docs.sparkSession.sparkContext.defaultParallelism
    return (partitions * BLOCKS_A_PARTITION - 1).bit_length()


def mine(docs: DataFrame, words: DataFrame, support: int, longest: int, filter_bits: int, size: int = SLICE_BYTES) -> DataFrame:
    """key, gram: all phrases (hashes) that reach their shard's part of the support in one shard at least.

    `docs` has key (of the label), shard, owner and text; `words` is the first level, all words of all shards with their counts.
    """
    bits, share = _block_bits(docs), docs.sparkSession.sparkContext.broadcast
    cells = words.groupBy("key", "shard").agg(F.sum("n").alias("w"))
    whole = cells.groupBy("key").agg(F.sum("w").alias("total"))
    least = F.expr(f"(cast(w AS decimal(20)) * {support} + total - 1) div total")
    cells = stage(cells.join(whole, "key").select("key", "shard", least.alias("least")), "collocation-cells")
    if cells.count() <= BROADCAST_CELLS:
        cells, heavy = F.broadcast(cells), None
    else:
        heavy = heavy_keys(docs, {"cell": ["key", "shard"]})["cell"]
    docs = left_join_default(docs, cells, ["key", "shard"], {"least": 1}, heavy=heavy, salt_by=["owner"])
    found = [stage(words.join(cells, ["key", "shard"]).filter("n >= least").select("key", "shard", "gram"), "collocation-1")]
    filters: dict[int, Broadcast] = {}
    for lengths in (range(2, 3), range(3, longest + 1)):
        if not lengths or lengths[-1] > longest:
            break
        own = F.col("gram").bitwiseXOR(_salt(F.col("shard").cast("bigint"))).alias("hash")
        filters[lengths[0] - 1] = share(_bit_table(found[-1].select(own), filter_bits))
        runs = _count_runs(docs, lengths, filters, bits, size)
        found.append(stage(_summed(runs).select("key", "shard", "gram"), f"collocation-{lengths[-1]}"))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union.select("key", "gram")


def often_in_all(docs: DataFrame, candidates: DataFrame, support: int, longest: int, filter_bits: int, size: int = SLICE_BYTES) -> DataFrame:
    """key, gram, check, owner, n of the candidates that occur `support` times in all documents of their label.

    What the bit table lets pass by mistake is counted as exactly as the rest.
    """
    passed = docs.sparkSession.sparkContext.broadcast(_bit_table(candidates.select(F.col("gram").alias("hash")), filter_bits))
    every = range(1, longest + 1)
    unsharded = docs.withColumns({"shard": F.lit(0), "least": F.lit(support).cast("bigint")})
    runs = _count_runs(unsharded, every, dict.fromkeys(every, passed), _block_bits(docs), size, told=True)
    return _summed(runs).select("key", "gram", "check", "owner", "n")


def texts_of(docs: DataFrame, phrases: DataFrame, longest: int, filter_bits: int, size: int = SLICE_BYTES) -> DataFrame:
    """key, gram, check, phrase: the texts of phrases, each from the documents of its owner."""
    own = F.col("gram").bitwiseXOR(_salt(F.col("owner").cast("bigint"))).alias("hash")
    wanted = docs.sparkSession.sparkContext.broadcast(_bit_table(phrases.select(own), filter_bits))

    def run(batches):
        table = _Bits(wanted.value)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            salt_of = _salt(batch.column("owner").to_numpy().astype(np.int64)).view(np.uint64)
            for some, rows in _slices(batch.column("text"), longest, size):
                row = rows[some.text]
                second = some.hashes(_BASES[1])
                checks = _phrases(some, second, keys.view(np.uint64)[row], longest, {}, second)
                found = _phrases(some, some.hashes(_BASES[0]), keys.view(np.uint64)[row], longest, {}, second)
                for (length, gram, stands), (_, check, _) in zip(found, checks):
                    at = np.flatnonzero(stands & some.new[length - 1 :])
                    at = at[table.has(gram[at] ^ salt_of[row[at]])]
                    _, first = np.unique(np.stack([gram[at], check[at]], axis=1), axis=0, return_index=True)
                    at = at[first]
                    told = (check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    texts = pa.array([some.words(i, i + length - 1) for i in at.tolist()], pa.string())
                    arrays = [pa.array(keys[row[at]]), pa.array(gram[at].view(np.int64)), pa.array(told), texts]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "gram", "check", "phrase"])

    found = docs.select("key", "owner", "text").mapInArrow(run, "key long, gram long, check int, phrase string")
    return found.groupBy("key", "gram", "check").agg(F.min("phrase").alias("phrase"))


def _part(first, size) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(counted: DataFrame) -> DataFrame:
    """label, phrase, a, l, r, n, score of every phrase of two words or more: that of its lowest-scoring cut."""
    known = counted.filter("phrase IS NOT NULL").withColumnRenamed("n", "a")
    words = F.split("phrase", " ", -1)
    phrases = known.withColumn("words", words).filter(F.size("words") > 1)
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("label", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.size("words")).alias("right"))
    heavy = heavy_keys(cut, {"left": ["label", "left"], "right": ["label", "right"], "label": ["label"]})
    for side, name in (("left", "l"), ("right", "r")):
        counts = known.select("label", F.col("phrase").alias(side), F.col("a").alias(name))
        cut = left_join_default(cut, counts, ["label", side], heavy=heavy[side], salt_by=["phrase", "k"])
    score = F.expr(f"(cast(a AS decimal(20)) * {SCALE}) div (cast(l AS decimal(20)) + r)")
    low = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    lowest = cut.groupBy("label", "phrase", "a").agg(low).select("label", "phrase", "a", "low.l", "low.r", "low.score")
    return left_join_default(lowest, counted.filter("phrase IS NULL").select("label", "n"), ["label"], heavy=heavy["label"])


def not_contained(scores: DataFrame) -> DataFrame:
    """Phrases but those of which 80 in 100 occurrences or more lie in one longer phrase of `scores`."""
    words = F.split("phrase", " ", -1)
    inner = scores.select("label", "a", words.alias("words")).filter(F.size("words") > 2)
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    inner = inner.select("label", "a", _part(F.col("first"), F.col("size")).alias("phrase"))
    within = inner.groupBy("label", "phrase").agg(F.max("a").alias("most"))
    joined = scores.join(within, ["label", "phrase"], "left")
    mostly = F.expr("cast(most AS decimal(20)) * 100 >= cast(a AS decimal(20)) * 80")
    return joined.filter(~F.coalesce(mostly, F.lit(False))).drop("most")


def first_of_each(scores: DataFrame, top: int) -> DataFrame:
    """The first `top` phrases of each label with their ranks: the first ones of each part of a label, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    near = scores.withColumn("part", part)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("label", "part").orderBy(*order)))
    near = near.filter(F.col("place") <= top).drop("place", "part")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order)).cast("bigint")
    return near.withColumn("rank", rank).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    label: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """label, rank, phrase, a, l, r, n and score of each label's first `top` collocations."""
    rows = docs.select(
        F.coalesce(F.col(label).cast("string"), F.lit("und")).alias("label"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    owner = F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int")
    rows = rows.withColumns({"key": F.xxhash64("label"), "owner": owner})
    rows = rows.withColumn("shard", F.pmod("owner", F.lit(shards)).cast("int"))
    every = rows.withColumn("least", F.lit(1).cast("bigint"))
    words = _summed(_count_runs(every, range(1, 2), {}, _block_bits(rows), slice_bytes)).select("key", "shard", "gram", "n")
    words = stage(words, "collocation-words")
    union = mine(rows, words, support, longest, filter_bits, slice_bytes)
    often = stage(often_in_all(rows, union, support, longest, filter_bits, slice_bytes), "collocation-often")
    labels = stage(rows.select("key", "label").distinct(), "collocation-labels")
    phrases = often.drop("owner").join(texts_of(rows, often, longest, filter_bits, slice_bytes), ["key", "gram", "check"])
    totals = words.groupBy("key").agg(F.sum("n").alias("n")).withColumn("phrase", F.lit(None).cast("string"))
    counted = phrases.select("key", "phrase", "n").unionByName(totals.select("key", "phrase", "n"))
    counted = left_join_default(counted, labels, ["key"], heavy=heavy_keys(often, {"label": ["key"]})["label"])
    scores = stage(scored(stage(counted.select("label", "phrase", "n"), "collocation-counts")), "collocation-scores")
    return first_of_each(not_contained(scores), top).select("label", "rank", "phrase", "a", "l", "r", "n", "score")
