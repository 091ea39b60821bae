import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelake.llm import packing
from hirelake.llm.packing import lengths
from hirelake.llm.queries import op1_harmonic_packing
from hirelake.llm.tokens import encoder, pieces, public_vocabulary
from tests.llm import brute
from tests.llm.conftest import SF

PATH = public_vocabulary("byte_bpe_50k.json")
odd = st.text(alphabet="ab .,'s!1\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 é日<|", max_size=40)


@settings(max_examples=400, deadline=None)
@given(odd)
def test_pieces_have_the_ids_of_the_whole_text(text):
    assert "".join(pieces(text)) == text
    assert next(encoder(PATH).encode([text])).tolist() == brute.ids(text)


def test_special_strings_and_forgetting():
    small = packing.encoder(PATH).__class__(PATH, remember=3)
    texts = [None, "", "one two three four five", "a<|endoftext|> b", "one two", "x" * 5000]
    assert [x.tolist() for x in small.encode(texts)] == [brute.ids(t) for t in texts]


def test_distinct_words_are_encoded_once_and_many_at_once():
    class Counting:
        def __init__(self, own):
            self.own, self.texts = own, []

        def encode_batch_fast(self, texts, **how):
            self.texts += texts
            return self.own.encode_batch_fast(texts, **how)

    own = packing.encoder(PATH).__class__(PATH, remember=4000)
    own._tokenizer = Counting(own._tokenizer)
    words = [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(500)]
    first, second = " ".join(words) + ".", "\n".join(w + "!?" for w in words)
    texts = [first, second, None, " \u00e9. a\u00a0 \u2003b <|endoftext|>. 's x's \u0085c", ""]
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [brute.ids(t) for t in texts]
    assert len(own._tokenizer.texts) < 100
    assert sum(len(t.split("\n")) for t in own._tokenizer.texts) < 1100


def test_lengths_fill_their_classes():
    assert lengths(0, 8) == [] and lengths(5, 4) == [4, 1] and lengths(7, 8) == [4, 2, 1] and lengths(2048 * 2 + 682, 2048) == [2048, 2048, 682]
    assert lengths(1100, 2048) == [1024, 75, 1] and lengths(3001, 2000) == [2000, 1000, 1] and lengths(3, 1) == [1, 1, 1]
    with pytest.raises(ValueError):
        lengths(3, 0)
    for capacity in (1, 7, 12, 64, 1000, 2000, 2048):
        each = [lengths(n, capacity) for n in range(2 * capacity)]
        assert all(sum(own) == n and own == sorted(own, reverse=True) for n, own in enumerate(each))
        used = {x for own in each for x in own}
        assert used <= {capacity // j for j in range(1, capacity + 1)} and len(used) <= 2 * capacity**0.5
        assert all(capacity - capacity // x * x < min(x, capacity // x) or x == 1 for x in used)
    assert np.mean([len(lengths(n, 2048)) for n in range(1, 2048)]) < 3.5


def check(rows, docs, capacity, end_id):
    tokens = {d: [*brute.ids(t), end_id] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        own = tokens[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == brute.crc(own[r["start"] : r["start"] + r["length"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in tokens.items():
        assert gapless(by_doc[d]) == len(own)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    totals = [gapless(x) for x in by_sequence.values()]
    assert all(t <= capacity for t in totals)
    return totals


def gapless(spans):
    at = 0
    for start, length in sorted(spans):
        assert start == at
        at += length
    return at


def test_whole_table_is_packed_with_little_padding(spark, documents):
    totals = check(op1_harmonic_packing(spark, SF).collect(), documents, 2048, 1)
    padding = sum(2048 - t for t in totals if t & (t - 1))
    assert padding <= 0.004 * sum(totals) + 2048


@pytest.mark.parametrize("capacity", [1, 12, 1000, 2000])
def test_any_capacity(spark, make_docs, capacity):
    docs = [(i, f"text number {i} " * (i * i % 37)) for i in range(60)]
    totals = check(packing.pack(make_docs(docs).repartition(5), PATH, capacity, 1).collect(), docs, capacity, 1)
    assert sum(capacity - t for t in totals) <= 0.02 * sum(totals) + 2 * capacity


def test_left_over_pieces_fit_side_by_side():
    left = {50: 1, 33: 2, 14: 5, 9: 9, 1: 60}
    runs, used = packing._first_fit(left, 100)
    taken = [[0] * 100 for _ in range(used)]
    for length, own in runs.items():
        ends = [*[first for first, _, _ in own[1:]], left[length]]
        for (first, sequence, offset), end in zip(own, ends):
            for i in range(offset, offset + (end - first) * length):
                taken[sequence][i] += 1
    assert sum(map(sum, taken)) == sum(n * length for length, n in left.items()) and max(map(max, taken)) == 1
    assert used == 4


def test_edge_cases(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "word " * 3000), (-4, "a b c"), (None, "d")]
    frame = make_docs(docs).repartition(3)
    check(packing.pack(frame, PATH, 64, 7).collect(), docs, 64, 7)
    twice = frame.unionByName(frame)
    rows = packing.pack(twice, PATH, 64, 7)
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).filter("sum(length) > 64").isEmpty()
    assert rows.count() == 2 * packing.pack(frame, PATH, 64, 7).count()
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_sequences_hold_the_ids(spark, make_docs):
    docs = [(i, f"text number {i} " * i) for i in range(20)]
    packed = packing.pack(make_docs(docs), PATH, 32, 9, with_ids=True)
    held = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    tokens = {d: [*brute.ids(t), 9] for d, t in docs}
    for r in packed.collect():
        at, n = r["offset"], r["length"]
        assert held[r["sequence_id"]][at : at + n] == tokens[r["doc_id"]][r["start"] : r["start"] + n]
