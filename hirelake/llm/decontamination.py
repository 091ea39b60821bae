"""Benchmark items contained in documents: size-partitioned MinHash search, exact verification.

An item's shingles are hashed once; its sketch is k of the hashes, those that fewest items have and of
these the smallest, so what many items begin or end with is in the sketch of none that has enough of
its own. Items are partitioned by the number of their shingles, and k grows with the size class: it is one more than the
number of shingles an item of that class may miss at the threshold. So a document that contains enough
of an item must hold at least one hash of the sketch, however long the document is, and the search loses
nothing. Documents found that way are compared with just the items that they share a hash with, by the shingles themselves.

Texts are compared by lower-cased words of letters and digits, in shingles of five. An item of fewer
words is one shingle, and for each number of words that such items have, documents are searched by shingles of
that size too, so a short item is found wherever its words stand in a row. Every distinct text
of an item is searched on its own, with or without an item_id, and reported under each item_id that it
has, under a null one only if it has no other; an item without a word is never found. Documents are told
by doc_id and text, so what one row holds decides neither for nor against another text of its doc_id or
another row without one; only the report has one row for each doc_id and item, that of the text that
holds most of it. A null text has no words. An empty table gives no rows. Long texts are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.text import free_name, let
from hirelake.operators.skew import heavy_keys, left_join_default
from hirelake.sources.staging import stage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 1 << 26
_CLASSES = 31  # sizes below 2^31


def plain_words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def _shingles(words: Column, size: int, join) -> Column:
    """`join(array, i)` for each place of a shingle, or of the whole array if that is shorter."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.when(F.size(words) > 0, F.transform(places, lambda i: join(words, i))).otherwise(F.array())


def _of_sizes(words: Column, sizes: Sequence[int], join) -> Column:
    """Distinct shingles of all the sizes, each made by `join(array, i, size)`."""
    made = lambda own: [_shingles(own, size, lambda w, i, size=size: join(w, i, size)) for size in sizes]
    return F.array_distinct(let(words, lambda own: F.concat(*made(own)) if len(sizes) > 1 else made(own)[0]))


def shingle_hashes(text: Column, sizes: Sequence[int] = (SHINGLE_WORDS,)) -> Column:
    """Distinct 64-bit hashes of the shingles; places beyond a short text count as null words, which change no hash."""
    join = lambda own, i, size: F.xxhash64(*[F.get(own, i + k) for k in range(size)])
    return _of_sizes(F.transform(plain_words(text), lambda w: F.xxhash64(w)), sizes, join)


def shingle_texts(text: Column, sizes: Sequence[int] = (SHINGLE_WORDS,)) -> Column:
    """Distinct shingles, words joined by a space."""
    join = lambda own, i, size: F.array_join(F.slice(own, i + 1, size), " ")
    return _of_sizes(plain_words(text), sizes, join)


def _sizes_of(texts: DataFrame, size: int) -> list[int]:
    """The size of shingles, and the smaller numbers of words that some items have."""
    words = F.size(plain_words(F.col("text")))
    short = texts.select(words.alias("n")).filter((F.col("n") > 0) & (F.col("n") < size)).distinct()
    return [size, *sorted(r["n"] for r in short.collect())]


def least_shared(size: int, threshold: float) -> int:
    """How many of `size` shingles make a share of at least the threshold."""
    return math.ceil(threshold * size - 1e-9)


def sketches(items: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """item, hash: of each item's hashes those that fewest items have, as many as its size class needs."""
    hashes = items.select("item", F.explode(shingle_hashes(F.col("text"), [size])).alias("hash"))
    often = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    heavy = heavy_keys(hashes, {"hash": ["hash"]})["hash"]
    # Spark sizes what is exploded by the texts before; neither here nor below may it choose to broadcast it.
    ranked = left_join_default(hashes, often.hint("merge"), ["hash"], heavy=heavy, salt_by=["item"])
    own = ranked.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("own"))
    needed = F.lit(None).cast("int")
    for c in range(_CLASSES):  # class c: sizes from 2^c to 2^(c+1) - 1
        largest = (1 << (c + 1)) - 1
        kept = largest - least_shared(largest, threshold) + 1
        needed = F.when(F.size("own") >= (1 << c), F.lit(kept)).otherwise(needed)
    rarest = F.slice("own", F.lit(1), needed)
    return own.select("item", F.explode(rarest).alias("_kept")).select("item", "_kept.hash")


def _numbered(items: DataFrame) -> DataFrame:
    """item, text: the distinct texts of items by their words, numbered."""
    texts = items.select(F.array_join(plain_words(F.col("text")), " ").alias("text")).filter("text <> ''").distinct()
    return stage(texts.withColumn("item", F.monotonically_increasing_id()), "item-texts")


def _named(items: DataFrame, texts: DataFrame) -> DataFrame:
    """item, item_id: each id of every text, null only for a text without any."""
    own = items.select("item_id", F.array_join(plain_words(F.col("text")), " ").alias("text")).distinct()
    named = own.filter("item_id is not null").join(texts, "text").select("item", "item_id")
    return texts.select("item").join(named, "item", "left")


def _small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """Broadcast what was counted to have at most so many rows and `BROADCAST_BYTES` of text, else join by shuffle."""
    texts = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    size = F.sum(reduce(Column.__add__, texts)) if texts else F.lit(0)
    rows, held = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= broadcast_rows and (held or 0) <= BROADCAST_BYTES else df.hint("merge")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _matching(docs: DataFrame, found: DataFrame, name: str, how: str, broadcast_rows: int) -> DataFrame:
    """Join `docs`, which have the hash of their text as `name`, with `found` by doc_id and text_hash."""
    renamed = {"doc_id": free_name(docs, "found_id"), "text_hash": free_name(docs, "found_hash")}
    right = _small(found, broadcast_rows).withColumnsRenamed(renamed)
    same = docs["doc_id"].eqNullSafe(right[renamed["doc_id"]]) & (docs[name] == right[renamed["text_hash"]])
    return docs.join(right, same, how)


def _found(docs: DataFrame, texts: DataFrame, size: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """doc_id, text_hash, item, n_shared, n_item of every pair at or above the threshold."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", _text_hash(F.col("text")))
    index = stage(sketches(texts, size, threshold), "item-sketches")
    sizes_used = _sizes_of(texts, size)
    parts = stage(texts.select("item", F.explode(shingle_texts(F.col("text"), [size])).alias("shingle")), "item-shingles")
    sizes = parts.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    hashes = docs.select("doc_id", "text_hash", F.explode(shingle_hashes(F.col("text"), sizes_used)).alias("hash"))
    pairs = hashes.join(_small(index, broadcast_rows), "hash").select("doc_id", "text_hash", "item").distinct()
    pairs = stage(pairs, "candidate-pairs")
    candidates = _matching(docs, pairs.select("doc_id", "text_hash").distinct(), "text_hash", "left_semi", broadcast_rows)
    held = candidates.select("doc_id", "text_hash", F.explode(shingle_texts(F.col("text"), sizes_used)).alias("own"))
    wanted = pairs.join(_small(parts, broadcast_rows), "item")
    wanted = wanted.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    shared = held.join(wanted.hint("merge"), same & (F.col("own") == F.col("shingle")))
    counted = shared.groupBy("doc_id", "text_hash", "item").agg(F.count_distinct("own").alias("n_shared"))
    counted = counted.join(_small(sizes, broadcast_rows), "item")
    return counted.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    size: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or above the threshold.

    Two texts of one item_id give a row each. Item tables are broadcast only up to a counted number of
    rows; beyond it Spark joins by shuffle.
    """
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    texts = _numbered(items)
    found = _found(docs, texts, size, threshold, broadcast_rows)
    found = found.groupBy("doc_id", "item", "n_item").agg(F.max("n_shared").alias("n_shared"))
    named = found.join(_small(stage(_named(items, texts), "item-ids"), broadcast_rows), "item")
    return named.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    texts = _numbered(items.select(F.col("text").cast("string").alias("text")))
    found = _found(docs, texts, SHINGLE_WORDS, THRESHOLD, broadcast_rows)
    leaks = stage(found.select("doc_id", "text_hash").distinct(), "leaks")
    name = free_name(docs, "text_hash")
    return _matching(docs.withColumn(name, _text_hash(docs["text"])), leaks, name, "left_anti", broadcast_rows).drop(name)
