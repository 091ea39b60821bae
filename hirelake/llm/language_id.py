"""Language of texts and of spans within them.

The script of a word narrows the languages that may have written it: those for which the script makes
up at least one in a hundred letters of what was learned. Each word is scored for these by a character
trigram model. The Viterbi path over all words of a text, with a penalty for every switch, labels spans
of mixed-language text; a document's language is the one with most letters.

Learning takes texts and labels from about `LEARN_DOCUMENTS` documents of each label, drawn by a hash of
doc_id; the counts of their characters are summed in Spark. The bound is the only sample; every
text is labelled in full.

Defined results: a text that is null or has no letter is `und` with score 0, as is any text when
nothing was learned; rows are labelled one by one, so ties, repeated rows and null doc_ids do no harm.
Of languages with equally many letters, or words of equal scores, the alphabetically first is taken. Long
texts are labelled whole; texts are worked on some millions of characters at a time, and what is remembered
of words is bounded in bytes, so many languages take no more memory than few.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.files import to_batch

LEARN_DOCUMENTS = 1_500
SWITCH_PENALTY = 8.0
NEVER = -1e6
SCORE_BYTES = 64_000_000  # of the words, and again of the trigrams, that a worker remembers
GROUP_CHARACTERS = 4_000_000
_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"

# First code point, last code point and name of letter ranges; all else is "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)


def script(word: str) -> str:
    """Script of a word's first letter."""
    code = ord(word[0])
    return next((name for low, high, name in SCRIPTS if low <= code <= high), "other")


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numeric signs such as a subscript, which _LETTERS takes in, part them."""
    found = []
    for run in _LETTERS.findall(text.lower()) if text else []:
        if run.isalpha():
            found.append(run)
        else:
            found += ["".join(own) for is_letter, own in groupby(run, str.isalpha) if is_letter]
    return found


def grams(word: str) -> Iterator[str]:
    """A word's trigrams, bigrams and characters with its borders; contexts are prefixes."""
    padded = _START + _START + word + _END
    for i in range(2, len(padded)):
        yield padded[i - 2 : i + 1]


class Model:
    """Scores of words for each learned language."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]]):
        """`counts`: trigram counts by language; `scripts`: letters by language and script."""
        self.languages = sorted(counts)
        self._columns = []
        for language in self.languages:
            three, two, one = counts[language], Counter(), Counter()
            ctx3, ctx2 = Counter(), Counter()
            for gram, n in three.items():
                two[gram[1:]] += n
                one[gram[2]] += n
                ctx3[gram[:2]] += n
                ctx2[gram[1]] += n
            self._columns.append((three, ctx3, two, ctx2, one, sum(one.values())))
        names = {s for own in scripts.values() for s in own}
        self._allowed = {
            s: np.array([scripts[x].get(s, 0) * 100 >= max(1, sum(scripts[x].values())) for x in self.languages])
            for s in names
        }
        self._known_grams: dict[str, np.ndarray] = {}

    def _gram(self, gram: str) -> np.ndarray:
        """log P(last character | two before) for each language, smoothed by shorter contexts."""
        found = self._known_grams.get(gram)
        if found is None:
            values = []
            for three, ctx3, two, ctx2, one, total in self._columns:
                p = (one.get(gram[2], 0) + 1e-3) / (total + 1.0)
                p = (two.get(gram[1:], 0) + 5 * p) / (ctx2.get(gram[1], 0) + 5)
                p = (three.get(gram, 0) + 5 * p) / (ctx3.get(gram[:2], 0) + 5)
                values.append(math.log(p))
            found = self._known_grams[gram] = np.array(values)
            if len(self._known_grams) * (100 + found.nbytes) > SCORE_BYTES:
                self._known_grams = {}
        return found

    def word(self, word: str) -> np.ndarray:
        """Score of a word for each language; no language is preferred in a script nobody uses."""
        allowed = self._allowed.get(script(word))
        if allowed is None or not allowed.any():
            return np.zeros(len(self.languages))
        total = np.sum([self._gram(g) for g in grams(word)], axis=0)
        return np.where(allowed, total, NEVER)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float, words: np.ndarray | None = None) -> np.ndarray:
    """The best language of every word of several texts.

    The words of all texts come one after the other: `words` has the row of each in `scores`, which
    has one column for each language; without it each word has a row of its own. All texts advance side
    by side, the longest first, and leave the computation as they end.
    """
    words = np.arange(len(scores)) if words is None else words
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    total, kinds = len(words), scores.shape[1]
    stays, source = np.zeros((total, kinds), bool), np.zeros(total, np.int16)
    path = np.zeros(total, np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    value = np.zeros((int(active[0]) if longest else 0, kinds))
    for t in range(longest):
        at = starts[: active[t]] + t
        if t:
            value = value[: active[t]]
            best = value.argmax(axis=1)
            switched = value[np.arange(len(at)), best][:, None] - penalty
            stays[at] = value >= switched
            source[at] = best
            value = np.maximum(value, switched)
        value = value + scores[words[at]]
        ends = np.flatnonzero(sizes[: active[t]] == t + 1)
        path[at[ends]] = value[ends].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        current = path[at]
        before = np.where(stays[at, current], current, source[at])
        path[at - 1] = before
    return path


def learn(docs: DataFrame, usable: Column, documents: int = LEARN_DOCUMENTS) -> Model:
    """The model of the labelled rows for which `usable` holds; `lang` has the labels."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # One number for each label, of which there are as many as there are languages.
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model({}, {})
    shares = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, documents / n)])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(letters(text)).items():
                    counts[language, "script", script(word)] += n * len(word)
                    for gram in grams(word):
                        counts[language, "gram", gram] += n
            schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])
            yield to_batch([(*k, n) for k, n in counts.items()], schema)

    sampled = rows.filter(drawn).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = sampled.mapInArrow(run, "lang string, kind string, item string, n long")
    summed = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toPandas()
    tables: dict[str, dict[str, dict[str, int]]] = {"gram": {}, "script": {}}
    for language, kind, item, n in summed.itertuples(index=False):
        tables[kind].setdefault(language, {})[item] = int(n)
    return Model(tables["gram"], tables["script"])


class _WordScores:
    """Scores of the words met so far, one row each in a table that grows in place up to `SCORE_BYTES`."""

    def __init__(self, model: Model):
        self._model, self._known = model, {}
        kinds = max(1, len(model.languages))
        self._most = max(1, SCORE_BYTES // (8 * kinds))
        self.table = np.empty((1024, kinds))

    def rows_of(self, texts: list[list[str]]) -> np.ndarray:
        """The row of every word of the texts, one after the other."""
        words = {w for own in texts for w in own}
        if len(self._known) + len(words) > self._most:
            self._known = {}
        known = self._known
        new = words.difference(known)
        if len(known) + len(new) > len(self.table):
            grown = np.empty((max(2 * len(self.table), len(known) + len(new)), self.table.shape[1]))
            grown[: len(known)] = self.table[: len(known)]
            self.table = grown
        for word in new:
            self.table[len(known)] = self._model.word(word)
            known[word] = len(known)
        return np.fromiter((known[w] for own in texts for w in own), np.int64, sum(map(len, texts)))


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """First and last of texts that are about `GROUP_CHARACTERS` long together; a longer one is a group of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > GROUP_CHARACTERS:
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def label(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (its share of the letters) and spans (lang and number of words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", span)])

    def labelled(scores, names, ids, texts):
        found = [letters(t) for t in texts]
        lengths = np.array([len(own) for own in found], np.int64)
        words = scores.rows_of(found)
        path = viterbi(scores.table, lengths, penalty, words)
        at = 0
        for doc_id, own, n in zip(ids, found, lengths.tolist()):
            if not n:
                yield doc_id, "und", 0.0, []
                continue
            languages = path[at : at + n]
            at += n
            sizes = np.bincount(languages, weights=[len(w) for w in own], minlength=len(names))
            best = int(sizes.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(languages)) + 1).tolist(), n]
            spans = [{"lang": names[languages[a]], "words": b - a} for a, b in zip(cuts, cuts[1:])]
            yield doc_id, names[best], float(sizes[best] / sizes.sum()), spans

    def run(batches):
        model = shared.value
        scores, names = _WordScores(model), model.languages
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not names:
                yield to_batch([(i, "und", 0.0, []) for i in ids], schema)
                continue
            for first, last in _grouped(texts):
                yield to_batch(list(labelled(scores, names, ids[first:last], texts[first:last])), schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang string, words int>>")


def held_out(doc_id: Column, part: int = 2, parts: int = 4) -> Column:
    """Rows never learned from; a row without doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))
