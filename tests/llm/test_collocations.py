import re
from collections import Counter, defaultdict

import pytest

from hirelake.llm import collocations

COLUMNS = "text string, lang string"
NAMES = ("label", "rank", "phrase", "a", "l", "r", "n", "score")


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(docs, support, longest=4, top=2000):
    """Rows of the operator for (text, label) pairs, phrase by phrase."""
    counts, total = defaultdict(Counter), Counter()
    for text, label in docs:
        label = "und" if label is None else label
        for own in words_of(text):
            total[label] += len(own)
            for k in range(1, longest + 1):
                counts[label].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    rows = []
    for label, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in often.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            longer = (b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * b >= 80 * a for b in longer):
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(kept)[:top], 1):
            rows.append((label, rank, phrase.decode(), a, left, right, total[label], -score))
    return sorted(rows, key=repr)


@pytest.fixture
def made(spark):
    from pyspark.sql import functions as F

    def make(docs):
        names = "doc_id label key shard gram n a l r k words hash"  # names the operator uses itself
        return spark.createDataFrame(docs, COLUMNS).withColumns({n: F.lit(n) for n in names.split()})

    return make


def found(rows, df, support, **more):
    return rows(collocations.collocations(df, "lang", support, **more).select(*NAMES))


DOCS = [
    ("New York, new york! NEW\tYORK city\nnew york city hall", "en"),
    ("new york city hall is in new york city; the city hall", "en"),
    ("à la carte À la carte. à la carte", "fr"),
    ("a a a a a a a", None),
    ("a a. a a: a a", "und"),
    ("", "en"),
    (None, "en"),
    (None, None),
    (" \t ,;. ", "de"),
    ("x\x1cy x\x1cy x\x1cy \x0b z \x0c z \r z", "odd\tlabel"),
    ("a\x00 b a b, a\x00 b a b\x00 c; \x00 \x00 \x00", "nul"),
    ("日本 語 日本 語, 日本 語 \U0001f600 \U0001f600 \U0001f600", ""),
]


@pytest.mark.parametrize("support,shards,filter_bits", [(1, 8, 1 << 20), (2, 1, 64), (2, 3, 1 << 10), (3, 8, 1 << 20)])
def test_equals_a_plain_count(rows, made, support, shards, filter_bits):
    assert found(rows, made(DOCS), support, shards=shards, filter_bits=filter_bits) == plain(DOCS, support)


def test_repeated_rows_count_each(rows, made):
    docs = DOCS * 7
    assert found(rows, made(docs).repartition(5), 14) == plain(docs, 14)


def test_whole_table_at_production_parameters(spark, rows, documents):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in table.select("text", "lang").collect()]
    assert found(rows, table, collocations.SUPPORT) == plain(docs, collocations.SUPPORT)


@pytest.mark.parametrize("size", [1, 40, 1000])
def test_texts_are_cut_without_loss(rows, made, monkeypatch, size):
    monkeypatch.setattr(collocations, "COUNTED_AT_ONCE", 50)
    docs = [(" ".join(f"w{i % 7} v{i % 3}" + "." * (i % 11 == 0) for i in range(900)), "en"), ("y" * 100 + " z " + "y" * 100, "en")]
    docs += [("", "en"), ("short text", "en")] * 20
    assert found(rows, made(docs).coalesce(1), 20, slice_bytes=size) == plain(docs, 20)


def test_a_very_long_text(rows, made):
    docs = [("one two three four five " * 250_000, "en")]
    assert len(docs[0][0]) > collocations.SLICE_BYTES
    assert found(rows, made(docs), 30) == plain(docs, 30)


def test_ties_and_top(rows, made):
    docs = [("b c. a b. c d. é f. z y", "en")] * 5
    assert found(rows, made(docs), 5, top=3) == plain(docs, 5, top=3)
    assert found(rows, made(docs), 5) == plain(docs, 5)


def test_empty_table(made):
    assert collocations.collocations(made([])).collect() == []


def test_local_support_misses_nothing_in_uneven_shards(rows, made):
    # One shard holds nearly all words, others a few; the phrase occurs exactly as often as asked.
    docs = [(f"filler{i} " * 50, "en") for i in range(20)] + [(f"rare pair{'.' * i}", "en") for i in range(6)]
    assert found(rows, made(docs), 6, shards=8) == plain(docs, 6)
