"""Token ids of whole texts by a public tokenizer file, with every distinct piece of text encoded once."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

_SPLITS_UNEVENLY = re.compile(r"\s\s|[\x1c-\x1f]")
_NOT_SPACE_EVERYWHERE = re.compile(r"[\x1c-\x1f]")
_SPACED_PIECE = re.compile(r"\s*\S+|\s+")
_CUT = "\x1f"
_LINES, _AT_ONCE = 64, 512  # words in a text, and texts handed to the tokenizer at once
_MARKS = ".,;:!?%&*$#|"
_BATCH_BYTES = 8_000_000
#: The same as _SPLITS_UNEVENLY, with Unicode white space spelled out.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = _SPACE + _SPACE + r"|[\x{1c}-\x{1f}]"
#: A word that stays the same between line breaks: no white space but one space in front, nothing unusual at either end.
_ONE_LINE = r"\A ?[\pL\pN\pP\pS](?:[^\s\x{1c}-\x{1f}\x{85}\pZ]*[\pL\pN\pP\pS])?\z"
REMEMBER = 1_200_000
_encoders: dict[tuple[str, int], "Encoder"] = {}


def public_vocabulary(name: str) -> str:
    """Path of a public tokenizer file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_bound(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values(), default=0) + 1


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The content of a tokenizer file of the driver, for all tasks; some megabytes."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encoder(source: str | Broadcast, remember: int = REMEMBER) -> "Encoder":
    """The encoder of a file or of a shared one, one per Python worker. A remembered piece takes about 200 bytes."""
    content = source.value if isinstance(source, Broadcast) else None
    key = (source if content is None else f"content {hash(content)}", remember)
    if key not in _encoders:
        _encoders[key] = Encoder(source if content is None else "", remember, content)
    return _encoders[key]


def pieces(text: str) -> list[str]:
    """Cut a text where byte-level pre-tokenization cuts it as well, so that ids of pieces add up.

    It cuts before a white-space run and never inside what follows; a space that is not followed
    by further white space belongs to the next word, a line break to none. Texts with control
    characters that only some libraries take for white space stay whole.
    """
    if not _SPLITS_UNEVENLY.search(text):
        return text.replace(" ", _CUT + " ").replace("\n", f"{_CUT}\n{_CUT}").split(_CUT)
    if _NOT_SPACE_EVERYWHERE.search(text):
        return [text]
    return _SPACED_PIECE.findall(text)


def _word_and_marks(piece: str) -> tuple[str, str]:
    """A word and the marks behind it, which no token spans; the marks may be empty."""
    word = piece.rstrip(_MARKS)
    return (word, piece[len(word) :]) if word and word[-1].isalpha() else (piece, "")


class Encoder:
    """Encodes batches of texts; remembers at most `remember` words and marks, and drops those longest unused.

    Texts are cut by the bytes of their Arrow column, pieces and words are numbered as columns, and ids are gathered
    from one; only distinct words become strings. Words that are not remembered are encoded many at once, a line each,
    where the tokenizer cuts at line breaks.
    """

    def __init__(self, path: str, remember: int = REMEMBER, content: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path) if content is None else Tokenizer.from_str(content)
        self._line_break = _line_break(self._tokenizer)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._remember = remember

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text, without special tokens; none for null."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // _BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield from self._ids(pc.fill_null(column.slice(start, stop - start), "").cast(pa.string()))

    def _ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        alone = set(np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist())
        cut, first = _cut_evenly(pc.if_else(uneven, "", texts) if alone else texts)
        numbered = cut.dictionary_encode()
        words = _words_and_marks(numbered.dictionary).dictionary_encode()
        blobs = pa.array(self._blobs(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        # A word and its marks follow each other, so every second border is one of a piece.
        whole = np.ascontiguousarray(_borders(blobs, np.int64)[::2])
        buffers = [None, pa.py_buffer(whole), blobs.buffers()[2]]
        found = pa.Array.from_buffers(pa.large_binary(), len(whole) - 1, buffers).take(numbered.indices)
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4")
        borders = (_borders(found, np.int64)[first] // 4).tolist()
        for i, (start, stop) in enumerate(zip(borders, borders[1:])):
            if i in alone:
                parts = [part for piece in pieces(texts[i].as_py()) for part in _word_and_marks(piece)]
                yield np.frombuffer(b"".join(self._blobs(parts)), "<u4")
            else:
                yield ids[start:stop]

    def _blobs(self, parts: list[str]) -> list[bytes]:
        """The ids of each word or marks as bytes."""
        found = list(map(self._known.get, parts))
        missing = [i for i, blob in enumerate(found) if blob is None]
        if missing:
            if len(self._known) + len(missing) > self._remember // 2:
                self._known, self._older = {}, self._known
            known = self._known
            for i in missing:
                found[i] = self._older.get(parts[i])
            known.update((parts[i], found[i]) for i in missing if found[i] is not None)
            new = list(dict.fromkeys(parts[i] for i in missing if found[i] is None))
            encoded = dict(zip(new, self._encoded(new)))
            known.update(encoded)
            for i in missing:
                if found[i] is None:
                    found[i] = encoded[parts[i]]
        return found

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words as bytes, by the tokenizer."""
        fit = [False] * len(words)
        if self._line_break is not None:
            fit = pc.match_substring_regex(pa.array(words, pa.string()), _ONE_LINE).to_numpy(zero_copy_only=False).tolist()
        in_lines = [w for w, fits in zip(words, fit) if fits]
        groups = [in_lines[i : i + _LINES] for i in range(0, len(in_lines), _LINES)]
        blobs: list[bytes] = []
        for group, encoding in zip(groups, self._by_tokenizer(["\n".join(g) for g in groups])):
            ids = np.array(encoding.ids, "<u4")
            raw, breaks = ids.tobytes(), (4 * np.flatnonzero(ids == self._line_break)).tolist()
            blobs += [raw[a:b] for a, b in zip([0, *(x + 4 for x in breaks)], [*breaks, len(raw)])]
        if len(blobs) != len(in_lines):
            raise ValueError("the tokenizer does not cut at line breaks")
        others = (array("I", e.ids).tobytes() for e in self._by_tokenizer([w for w, fits in zip(words, fit) if not fits]))
        lines = iter(blobs)
        return [next(lines if fits else others) for fits in fit]

    def _by_tokenizer(self, texts: list[str]) -> Iterator:
        for start in range(0, len(texts), _AT_ONCE):
            yield from self._tokenizer.encode_batch_fast(texts[start : start + _AT_ONCE], add_special_tokens=False)


def _borders(column: pa.Array, kind: type) -> np.ndarray:
    """Where the values of a column of texts or bytes begin and end in its buffer."""
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def _cut_evenly(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, as `pieces` cuts texts without uneven white space, and where those of each text begin and end."""
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    borders = _borders(texts, np.int32).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[borders[0] : borders[-1]]
    breaks = data == ord("\n")
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = breaks | (data == ord(" "))
    cut[1:] |= breaks
    cut[borders - borders[0]] = True
    at = np.flatnonzero(cut)
    buffers = [None, pa.py_buffer((at + borders[0]).astype(np.int32)), texts.buffers()[2]]
    return pa.Array.from_buffers(pa.string(), len(at) - 1, buffers), np.searchsorted(at, borders - borders[0])


def _words_and_marks(distinct: pa.Array) -> pa.Array:
    """Two values for each piece: its word and the marks behind it, as `_word_and_marks` has them."""
    words = pc.utf8_rtrim(distinct, characters=_MARKS)
    sizes = pc.if_else(pc.match_substring_regex(words, r"\pL\z"), pc.binary_length(words), pc.binary_length(distinct))
    if not len(distinct):
        return distinct
    borders = _borders(distinct, np.int32)
    both = np.empty(2 * len(distinct) + 1, np.int32)
    both[::2] = borders
    both[1::2] = borders[:-1] + sizes.to_numpy(zero_copy_only=False)
    return pa.Array.from_buffers(pa.string(), 2 * len(distinct), [None, pa.py_buffer(both), distinct.buffers()[2]])


def _line_break(tokenizer) -> int | None:
    """The id of a line break, if the tokenizer cuts before and after each that stands between words; else None."""
    own = json.loads(tokenizer.to_str())
    kind = own["pre_tokenizer"] or {}
    byte_level = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
    added = own["added_tokens"]
    if own["normalizer"] or not byte_level or any(t["lstrip"] or t["rstrip"] or t["single_word"] or "\n" in t["content"] for t in added):
        return None
    ids = tokenizer.encode("\n", add_special_tokens=False).ids
    return ids[0] if len(ids) == 1 else None
