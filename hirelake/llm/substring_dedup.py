"""Exact substring dedup: words covered by a window of words that also starts earlier are removed.

A window starts earlier in a document of smaller key, or earlier in the same document. Suffix automata
of reference shards find it: for every place of a document they give the longest match so far and
where the last `window` words of it stand first. The corpus is its own reference, so only text that can
repeat enters: each window has an anchor, the run of words with the least hash in it, and equal windows
have equal anchors at the same place. Anchors that occur once are dropped. The reference of an anchor is
its surroundings where it stands first of all; shards collect the references of some blocks of these
documents, `BLOCK_WORDS` words each, up to about `SHARD_WORDS` words in all however long a document is, and a
shard's automaton is sent only to the tasks that stream text sharing an anchor with it, as often as its
share of that text asks for.

A window whose anchor occurs earlier but which the shard does not hold may still repeat in later
documents, with other words around the anchor. Such windows go through another round, in which the
window's own hash takes the anchor's place, so its first document surely holds it. Words are compared
as they are; hashes only decide what meets where, and rounds go on, with another hash, until no window
is open.

Defined results: a null or empty text has no words; keys are the doc_ids where these are unique and
none is null, else rows are ordered by doc_id (null first) and text, and rows equal in both are one
document. A document must fit in the memory of a task; there is no other limit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.automaton import SuffixAutomaton
from hirelake.llm.files import to_batch
from hirelake.llm.text import SEPARATOR
from hirelake.operators.ordering import sequential_id
from hirelake.sources.staging import stage

WINDOW = 20
ANCHOR = 8
SHARD_WORDS = 40_000
BLOCK_WORDS = 2_000
SHARD_MARGIN = 2  # blocks meet in shards by a hash, so shards are planned for a part of their words
SPLIT_WORDS = 200_000
BROADCAST_ROWS = 1_000_000
HASHED_AT_ONCE = 1_000_000  # bytes of text
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GRAMS = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("lead", pa.bool_())])
_SEGMENTS = pa.schema(
    [("shard", pa.int32()), ("role", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("body", pa.binary()), ("own", pa.binary())]
)
_FOUND = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("gram", pa.int64())])


class _Hashes:
    """64-bit hashes of words under one seed: their bytes, each times a number of its place, added up and mixed."""

    def __init__(self, seed: int):
        self._from = np.uint64(seed + 1 << 40)
        self._numbers = self._number(np.arange(256))

    def _number(self, places: np.ndarray) -> np.ndarray:
        return gram_hashes((places.astype(np.uint64) + self._from) * np.uint64(0x9E3779B97F4A7C15), 1)

    def of_bytes(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of texts that stand behind each other, and where words begin; `borders` are those of the texts."""
        inside = ~_WHITE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at_text = borders[borders < len(data)]
        begins[at_text] = inside[at_text]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        lengths = np.diff(starts, append=len(data))
        places = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        numbers = self._numbers[places] if lengths.max() <= len(self._numbers) else self._number(places)
        # White space behind a word adds nothing.
        numbers *= (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * inside[starts[0] :]
        return gram_hashes(np.add.reduceat(numbers, starts - starts[0]), 1), starts

    def of_each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Hashes of the words of each text, for some texts at a time."""
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // HASHED_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            found, _, first = self.of_column(texts.slice(a, b - a))
            yield from (found[i:j] for i, j in zip(first.tolist(), first[1:].tolist()))

    def of_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, where words begin, and which word is the first of each text; with the end."""
        borders = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
        found, starts = self.of_bytes(data, borders[:-1] - borders[0])
        return found, starts, np.searchsorted(starts, borders - borders[0])


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = max(0, len(hashes) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value of every run of `width` values, the first of equal ones."""
    places, known = np.arange(len(values)), 1
    while known < width:
        step = min(known, width - known)
        left, right = places[:-step], places[step:]
        places = np.where(values[right] < values[left], right, left)
        known += step
    return places


def anchors(hashes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and for every window the place of its least one."""
    grams = gram_hashes(hashes, size)
    if len(hashes) < window:
        return grams, np.empty(0, np.int64)
    return grams, _least_places(grams, window - size + 1)


def _document_anchors(docs: DataFrame, window: int, size: int) -> DataFrame:
    """gram, key, pos of every anchor, and whether it is the document's first one of its words."""

    def found(hashes: _Hashes, keys: np.ndarray, texts: pa.Array) -> list[np.ndarray]:
        words, _, first = hashes.of_column(texts)
        grams, chosen = anchors(words, window, size)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        # A window lies in one text; places of later windows are never smaller.
        chosen = chosen[text_of[: len(chosen)] == text_of[len(text_of) - len(chosen) :]]
        chosen = chosen[np.diff(chosen, prepend=-1) > 0]
        own, text = grams[chosen].view(np.int64), text_of[chosen]
        order = np.lexsort((own, text))
        lead = np.zeros(len(own), bool)
        lead[order] = (np.diff(own[order], prepend=0) != 0) | (np.diff(text[order], prepend=-1) != 0)
        return [own, keys[text], (chosen - first[text]).astype(np.int32), lead]

    def run(batches):
        hashes = _Hashes(0)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // HASHED_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            parts = [found(hashes, keys[a:b], texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=_GRAMS)

    return docs.mapInArrow(run, "gram long, key long, pos int, lead boolean")


def _spans(places: np.ndarray, before: int, after: int, end: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, places in it) of the joined surroundings of sorted places."""
    starts, stops = np.maximum(places - before, 0), np.minimum(places + after, end)
    cuts = np.flatnonzero(starts[1:] > stops[:-1]) + 1
    for i, j in zip([0, *cuts], [*cuts, len(places)]):
        yield int(starts[i]), int(stops[j - 1]), places[i:j]


def _cut(docs: DataFrame, hits: DataFrame, shards: int, before: int, after: int) -> DataFrame:
    """Segments of documents around their hits, for the shard of the block that has the hit first of all; that is its reference."""

    def run(batches):
        for batch in batches:
            rows, hits = [], batch.column("hits")
            ends = hits.offsets.to_numpy()
            flat = hits.values.slice(ends[0], ends[-1] - ends[0])
            every, first, place = (flat.field(c).to_numpy().astype(np.int64) for c in ("pos", "first", "place"))
            keys = batch.column("key").to_numpy()
            block = gram_hashes(first.view(np.uint64), 1) + (place // BLOCK_WORDS).astype(np.uint64)
            shards_of = (gram_hashes(block, 1) % np.uint64(shards)).astype(np.int64)
            roles = ((first != np.repeat(keys, np.diff(ends))) | (place != every)).astype(np.int64)
            borders = (ends - ends[0]).tolist()
            for key, text, a, b in zip(keys.tolist(), batch.column("text").to_pylist(), borders, borders[1:]):
                words = text.encode().split()
                places, shard, role = every[a:b], shards_of[a:b], roles[a:b]
                order = np.lexsort((places, role, shard))
                group = shard[order] * 2 + role[order]
                cuts = np.flatnonzero(np.diff(group)) + 1
                for at in np.split(order, cuts):
                    for start, stop, own in _spans(places[at], before, after, len(words)):
                        body = b" ".join(words[start:stop])
                        held = (own - start).astype("<i4").tobytes()
                        rows.append((int(shard[at[0]]), int(role[at[0]]), key, start, stop - start, body, held))
            yield to_batch(rows, _SEGMENTS)

    grouped = hits.groupBy(F.col("key").alias("hit_key")).agg(F.collect_list(F.struct("pos", "first", "place")).alias("hits"))
    joined = docs.join(grouped, F.col("key") == F.col("hit_key")).select("key", "text", "hits")
    return joined.mapInArrow(run, "shard int, role int, key long, start int, words int, body binary, own binary")


def _dealt(segments: DataFrame, broadcast_rows: int) -> DataFrame:
    """Add split: a shard's documents are split by key when they are many; its references go to all."""
    sizes = segments.filter("role = 1").groupBy("shard").agg(F.sum("words").alias("total"))
    parts = F.ceil(F.col("total") / SPLIT_WORDS).cast("int").alias("parts")
    large = sizes.filter(F.col("total") > SPLIT_WORDS).select("shard", parts)
    large = F.broadcast(large) if large.count() <= broadcast_rows else large
    rows = segments.join(large, "shard", "left")
    parts = F.coalesce("parts", F.lit(1))
    everywhere = F.sequence(F.lit(0), parts - 1)
    own = F.array(F.pmod(F.xxhash64("key"), parts).cast("int"))
    split = F.explode(F.when(F.col("role") == 0, everywhere).otherwise(own)).alias("split")
    return rows.select("shard", split, "role", "key", "start", "body", "own")


def _streamed(segments: DataFrame, window: int, size: int, seed: int) -> DataFrame:
    """Removed ranges (gram null) and open windows (gram set) of all segments.

    Rows come sorted, so each shard's references arrive before the documents that are streamed
    through its automaton; a task holds one automaton at a time.
    """

    def judged(hashes, automaton, key, start, words, own):
        """Ranges to remove, then windows that stay open with their hashes; a reference has neither hashes nor open windows."""
        found = np.zeros(max(0, len(words) - window + 1), bool)
        for at, first in automaton.first_places(words, window):
            found[at] = first < (key, start + at)
        rows = []
        edges = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            rows.append((key, start + a, start + b + window - 1, None))
        if own is None or found.all():
            return rows
        if size == window:
            chosen = np.arange(len(found))
        else:
            _, chosen = anchors(hashes[0], window, size)
        left = np.flatnonzero(~found & np.isin(chosen, own))
        if len(left):
            grams = gram_hashes(hashes[-1], window)[left].view(np.int64)
            rows += [(key, start + a, start + a + window, g) for a, g in zip(left.tolist(), grams.tolist())]
        return rows

    def run(batches):
        current, automaton, references = None, SuffixAutomaton(), []
        kinds = [_Hashes(n) for n in ((0, seed) if size < window else (seed,))]

        def settled():
            rows = []
            for key, start, words in references:
                rows += judged(None, automaton, key, start, words, None)
            references.clear()
            return rows

        for batch in batches:
            rows = []
            hashed = zip(*[kind.of_each(batch.column("body")) for kind in kinds])
            for row, hashes in zip(batch.to_pylist(), hashed):
                words = row["body"].split()
                if current != (row["shard"], row["split"]):
                    rows += settled()
                    current, automaton = (row["shard"], row["split"]), SuffixAutomaton()
                if row["role"] == 0:
                    automaton.add(words, row["key"], row["start"])
                    if row["split"] == 0:
                        references.append((row["key"], row["start"], words))
                else:
                    rows += settled()
                    own = np.frombuffer(row["own"], "<i4")
                    rows += judged(hashes, automaton, row["key"], row["start"], words, own)
            yield to_batch(rows, _FOUND)
        yield to_batch(settled(), _FOUND)

    order = ["shard", "split", "role", "key", "start"]
    return (
        segments.repartition("shard", "split")
        .sortWithinPartitions(*order)
        .mapInArrow(run, "key long, start int, stop int, gram long")
    )


def _round(docs, grams, window, size, before, after, seed, broadcast_rows) -> DataFrame:
    place = F.expr("min_by(pos, key) FILTER (WHERE lead)").alias("place")
    repeated = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), place)
    repeated = stage(repeated.filter("n > 1").drop("n"), "repeated")
    shards = max(1, repeated.count() * (after - size // 2) // 2 * SHARD_MARGIN // SHARD_WORDS)
    hits = grams.join(repeated, "gram").select("key", "pos", "first", "place")
    segments = stage(_cut(docs, hits, shards, before, after), "segments")
    return stage(_streamed(_dealt(segments, broadcast_rows), window, size, seed), "matches")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key, start, stop: ranges of words to remove from documents (key, text); they may overlap."""
    size = min(anchor, window)
    grams = stage(_document_anchors(docs, window, size), "anchors")
    before, seed, removed = window - size, 1, None
    while True:
        found = _round(docs, grams, window, size, before, window, seed, broadcast_rows)
        ranges = found.filter("gram is null").select("key", "start", "stop")
        removed = ranges if removed is None else removed.unionByName(ranges)
        grams = found.filter("gram is not null").select("gram", "key", F.col("start").alias("pos"))
        grams = grams.withColumn("lead", F.col("pos") == F.min("pos").over(Window.partitionBy("gram", "key")))
        if grams.isEmpty():
            return removed
        size, before, seed = window, 0, seed + 1


def with_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add key, which orders documents: doc_id where it is unique, else a number by doc_id and text.

    The second table has key and text once for each key, however many rows are equal in both.
    """
    named = docs.withColumn("key", F.col("doc_id").cast("bigint"))
    again = named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or key is null")
    if again.isEmpty():
        return named, named.select("key", "text")
    named = docs.withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    order = ["doc_id", "digest"]
    numbered = sequential_id(stage(named.select(*order).distinct(), "documents"), order, ["key"])
    numbered = numbered.withColumnsRenamed({c: f"_{c}" for c in order})
    keyed = named.join(numbered, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]).drop("digest", "_doc_id", "_digest")
    return keyed, stage(keyed.select("key", "text").dropDuplicates(["key"]), "distinct-documents")


def _kept(words: int, ranges) -> np.ndarray:
    """Whether each word stays."""
    steps = np.zeros(words + 1, np.int64)
    for r in () if ranges is None else ranges:
        steps[r["start"]] += 1
        steps[r["stop"]] -= 1
    return np.cumsum(steps[:-1]) == 0


def _with_ranges(docs: DataFrame, ranges: DataFrame, broadcast_rows: int) -> DataFrame:
    per_key = ranges.groupBy(F.col("key").alias("range_key")).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    small = ranges.count() <= broadcast_rows
    return docs.join(F.broadcast(per_key) if small else per_key, F.col("key") == F.col("range_key"), "left")


def dedup_report(docs: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = (row["text"] or "").encode().split()
                stays = _kept(len(words), row["ranges"])
                body = b" ".join([w for w, s in zip(words, stays.tolist()) if s] if row["ranges"] else words)
                removed = len(words) - int(stays.sum())
                rows.append((row["doc_id"], len(words), removed, hashlib.sha256(body).hexdigest()))
            yield to_batch(rows, schema)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed, distinct = with_keys(own)
    ranges = repeated_ranges(distinct, window, broadcast_rows=broadcast_rows)
    joined = _with_ranges(keyed, ranges, broadcast_rows).select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents with repeated spans cut out of their texts, and n_chars counted anew, all columns kept.

    White space between kept words stays as it was, one space for a removed span. A document that
    loses all its words is dropped; one that had none stays.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _cut_out(t, own) for t, own in zip(texts, ranges)], dtype=object)

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(F.lit(0).alias("z"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("row")
    source = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), packed)
    keyed, distinct = with_keys(source)
    ranges = repeated_ranges(distinct, window, broadcast_rows=broadcast_rows)
    touched = F.col("ranges").isNotNull()
    new = cut.asNondeterministic()(F.when(touched, F.col("text")), F.col("ranges"))
    joined = _with_ranges(keyed, ranges, broadcast_rows).withColumn("new", new)
    kept = joined.filter(~touched | F.col("new").rlike("[^" + SEPARATOR[1:]))
    text = F.when(touched, F.col("new")).otherwise(F.col("text"))
    back = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        old = back["n_chars"]
        back["n_chars"] = F.when(touched, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def _cut_out(text: str, ranges) -> str:
    body = text.encode()
    spans = [m.span() for m in _WORD.finditer(body)]
    runs, last = [], None
    for (a, b), stays in zip(spans, _kept(len(spans), ranges).tolist()):
        if not stays:
            last = None
        elif last is None:
            runs.append(last := [a, b])
        else:
            last[1] = b
    return b" ".join(body[a:b] for a, b in runs).decode()
