"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without moving any pre-token.

First tier: the lengths, in tokens, of the pre-tokens that make up at least one in `SHARE` of the
corpus. At most `SHARE` of them can exist, so the table that every task gets has a proven bound. Tasks find
them by summaries of frequent items over all documents: a summary never holds more than a few times
`SUMMARY` pre-tokens, and what a task hands on is at most `SUMMARY` of them with counts. Second tier:
a pre-token that the table does not know is encoded once and remembered by the Python worker, up to
`REMEMBER` of them, then anew. Both tiers hold exact lengths, so they decide the time and never the count.

A pre-token here is a run of text that byte-level pre-tokenization cuts off as well: it starts at white
space and ends before the next; marks behind a Latin word are parted from it. Strings of special tokens inside a
text hold no white space, so a pre-token has them whole and the library treats them as it does by default.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; rows are counted one by one, so
repeated rows, null doc_ids and ties stay as they are; further columns are not read; an empty table gives no
row. Long texts are cut and counted in full, a few million bytes at a time.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.tokens import pieces
from hirelake.sources.staging import stage

SHARE = 1 << 16
SUMMARY = 1 << 14
REMEMBER = 1_000_000  # pre-tokens, about 120 bytes each
LIMIT = 512
BATCH_BYTES = 4_000_000
_CUT = "\x1f"
_MARKS = ".,;:!?%&*$#|"
_LATIN = 0x250  # letters below are letters in every version of Unicode
#: Two white-space characters in a row, or a control character that not all libraries take for white space.
_UNEVEN = (
    r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|[\x{1c}-\x{1f}]"
)
_counters: dict[str, "Lengths"] = {}


def _parts(texts: pa.Array) -> Iterator[tuple[pa.ListArray, int, int]]:
    """Pre-tokens of consecutive texts: lists, one for each text, and which texts they belong to."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for start, stop in zip(cuts, cuts[1:]):
        some = pc.fill_null(texts.slice(start, stop - start), "")
        uneven = pc.match_substring_regex(some, _UNEVEN)
        marked = pc.replace_substring(pc.if_else(uneven, "", some), " ", _CUT + " ")
        yield pc.split_pattern(pc.replace_substring(marked, "\n", f"{_CUT}\n{_CUT}"), _CUT), start, stop
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist():
            yield pa.array([pieces(some[i].as_py())], pa.list_(pa.string())), start + i, start + i + 1


def _shrunk(counts: dict[str, int], most: int) -> dict[str, int]:
    """The largest `most` counts, less the next one: a count is too low by that much at most."""
    if len(counts) <= most:
        return counts
    less = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -most - 1)[-most - 1])
    return {piece: n - less for piece, n in counts.items() if n > less}


def frequent(docs: DataFrame, share: int = SHARE, summary: int = SUMMARY) -> list[str]:
    """Pre-tokens that make up at least one in `share` of all, as the tasks' summaries show; at most `share`."""

    def run(batches):
        counts, total = Counter(), 0
        for batch in batches:
            for lists, _, _ in _parts(batch.column("text")):
                numbered = lists.flatten().dictionary_encode()
                times = np.bincount(numbered.indices.to_numpy(), minlength=len(numbered.dictionary))
                counts.update(dict(zip(numbered.dictionary.to_pylist(), times.tolist())))
                total += len(numbered)
                if len(counts) > 4 * summary:
                    counts = Counter(_shrunk(counts, summary))
        kept = _shrunk(counts, summary)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *kept], pa.string()), pa.array([total, *kept.values()], pa.int64())], ["piece", "n"]
        )

    heads = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string, n long")
    summed = stage(heads.groupBy("piece").agg(F.sum("n").alias("n")), "frequent-pieces")
    total = summed.filter("piece IS NULL").agg(F.max("n")).first()[0] or 0
    # Summed counts are no more than the real ones, so no more than `share` pieces pass.
    return [r[0] for r in summed.filter(F.col("piece").isNotNull() & (F.col("n") * share >= total)).collect()]


class Lengths:
    """Lengths of pre-tokens for one Python worker."""

    def __init__(self, vocabulary: str, names: str, lengths: bytes, remember: int):
        self._tokenizer = _tokenizer(vocabulary)
        self._frequent = dict(zip(names.split(_CUT), array("I", lengths))) if lengths else {}
        self._known: dict[str, int] = {}
        self._remember = remember

    def lengths(self, parts: list[str]) -> np.ndarray:
        """Tokens of each pre-token; `parts` are distinct."""
        frequent, known = self._frequent, self._known
        missing = [p for p in parts if p not in frequent and p not in known]
        if len(known) + len(missing) > self._remember:
            known = self._known = {}
            missing = [p for p in parts if p not in frequent]
        split = {p: _word_and_marks(p) for p in missing}
        rest = {x for pair in split.values() for x in pair if x not in frequent and x not in known}
        new = dict(zip(rest, _encoded_lengths(self._tokenizer, list(rest))))
        of = lambda x: frequent.get(x, known.get(x, new.get(x)))
        known.update([(p, of(word) + of(marks)) for p, (word, marks) in split.items()])
        return np.fromiter((frequent.get(p, known.get(p)) for p in parts), np.int64, len(parts))


def _word_and_marks(piece: str) -> tuple[str, str]:
    """A word and the marks behind it, which no token spans."""
    word = piece.rstrip(_MARKS)
    if word and ord(word[-1]) < _LATIN and word[-1].isalpha():
        return word, piece[len(word) :]
    return piece, ""


def _checked(vocabulary: str) -> str:
    """The content of a tokenizers file, if texts may be cut at white space for it."""
    has = json.loads(vocabulary)
    before = has.get("pre_tokenizer") or {}
    strings = [t["content"] for t in has.get("added_tokens") or []]
    if has.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or re.search(r"\s", "".join(strings)):
        raise ValueError("texts are cut at white space for byte-level BPE without normalizer, prefix space or spaced special tokens only")
    return vocabulary


def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(vocabulary)
    made.no_truncation()
    made.no_padding()
    return made


def _encoded_lengths(tokenizer, parts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, share: int = SHARE, summary: int = SUMMARY, remember: int = REMEMBER
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every row.

    `vocabulary` is the path of a tokenizers file of byte-level BPE on the driver; its content goes to the tasks.
    """
    content = _checked(Path(vocabulary).read_text(encoding="utf-8"))
    names = [p for p in frequent(docs, share, summary) if _CUT not in p]
    lengths = array("I", _encoded_lengths(_tokenizer(content), names)).tobytes()
    table = docs.sparkSession.sparkContext.broadcast((content, _CUT.join(names), lengths))

    def run(batches):
        key = str(hash((table.value[1:], remember)))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Lengths(*table.value, remember)
        counter = _counters[key]
        for batch in batches:
            texts = batch.column("text")
            found = np.zeros(len(texts), np.int64)
            for lists, start, stop in _parts(texts):
                numbered = lists.flatten().dictionary_encode()
                each = counter.lengths(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
                ends = np.concatenate(([0], np.cumsum(each)))[lists.offsets.to_numpy()]
                found[start:stop] += np.diff(ends)
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            over = pa.array(found > limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(found), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
