from pathlib import Path

import pytest

from hirelake.llm import token_counts
from hirelake.llm.queries import VOCABULARY, op13_token_counts
from hirelake.llm.tokens import public_vocabulary

from .brute import ids
from .conftest import SF

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a  b\t\tc \n d",
    "a<|endoftext|>b <|endoftext|> c<|endoftext|>.",
    "<|endoftext|",
    "it's, don't; we'll 'em x'.",
    "H₂O x², 中文。 عربي! café... \U0001f600\U0001f600",
    "one\x1ftwo \x1c three",
    " no  break　wide ",
    "tab\tand\r\nline\x0bfeed\x85next sep",
    "word,,, word. word!? 12,345.67 $5%",
    "x" * 3000,
]


def expected(pairs, limit=512):
    rows = []
    for doc_id, text in pairs:
        n = len(ids(text))
        rows.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(rows, key=repr)


def test_counts_of_the_whole_table(spark, documents, rows):
    assert rows(op13_token_counts(spark, SF)) == expected(documents)


@pytest.mark.parametrize("share,summary,remember", [(1 << 16, 1 << 14, 1_000_000), (8, 4, 16), (1, 1, 1)])
def test_odd_texts_in_either_tier(spark, rows, make_docs, share, summary, remember):
    pairs = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[4]), (3, ODD[4]), (None, "null id"), (None, None)]
    found = token_counts.count_tokens(make_docs(pairs), public_vocabulary(VOCABULARY), 512, share, summary, remember)
    assert rows(found) == expected(pairs)


def test_a_long_text_is_counted_in_full(spark, rows, make_docs):
    text = " ".join(f"word{i % 977}, {i}" for i in range(400_000))
    assert len(text) > token_counts.BATCH_BYTES
    pairs = [(1, text), (2, "short"), (3, text + "  end")]
    found = token_counts.count_tokens(make_docs(pairs), public_vocabulary(VOCABULARY))
    assert rows(found) == expected(pairs)


def test_empty_table(spark, make_docs):
    assert token_counts.count_tokens(make_docs([]), public_vocabulary(VOCABULARY)).collect() == []


def test_limit_is_exceeded_only_above_it(spark, make_docs):
    pairs = [(1, " the" * 4), (2, " the" * 5)]
    found = token_counts.count_tokens(make_docs(pairs), public_vocabulary(VOCABULARY), limit=4)
    assert {r["doc_id"]: r["over_limit"] for r in found.collect()} == {1: False, 2: True}


def test_frequent_pieces_are_bounded_and_found_whatever_the_split(spark, make_docs):
    docs = make_docs([(i, "often " * 30 + f"rare{i} odd{i}") for i in range(60)]).repartition(7, "doc_id")
    found = token_counts.frequent(docs, share=4, summary=2)
    assert " often" in found and len(found) <= 4


def test_other_kinds_of_vocabulary_are_refused(spark, make_docs, tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(make_docs([(1, "a")]), public_vocabulary("word_bpe_49k.json"))
    assert Path(public_vocabulary(VOCABULARY)).exists()
