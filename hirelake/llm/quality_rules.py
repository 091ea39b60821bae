"""Quality rules as a cascade that stops at the first rule a document fails.

Each rule's cost and share of rejections are measured on a small sample; rules then run in descending
order of rejections per cost, so that most bad documents never reach a costly rule. The order steers
the work alone: a document is kept when no rule rejects it, in whatever order they run.

Costs are those of the columns that run: the rules of `judge` are timed on measures already taken, over
sample rows that pass the base rules, those of `keep_good` on words already split.

Defined results: a null or empty text has no words and fails `few_words`; repeated rows get equal
verdicts; a table without rows has no measurable sample, which leaves the rules as listed. Texts are judged
whole, however long; only sample texts are cut, at `SAMPLE_CHARACTERS`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.text import SEPARATOR, free_name, let, word_array
from hirelake.sources.staging import stage

WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
SAMPLE_ROWS = 500
SAMPLE_CHARACTERS = 1 << 16
OWN_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_RULES = ("few_words", "repeated_windows")
SYMBOLS = "[#*$%&|<>]"

Measure = Callable[[str], Column]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of `window` words that occur at least twice in the array.

    Windows are compared by 64-bit hashes of their words; sorting happens only where any repeat.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda pairs: let(F.sort_array(_starts(pairs)), _length))

    def _starts(pairs: Column) -> Column:
        same = lambda p, k: F.get(pairs, k)["h"].eqNullSafe(p["h"])
        return F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])

    def _length(starts: Column) -> Column:
        gap = F.transform(starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window))))
        return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    def hashed(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(own) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)]))

    many = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda own: let(hashed(own), count))
    return F.when(F.size(words) > window, many(words)).otherwise(F.lit(0))


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return F.size(lines) - F.size(F.array_distinct(lines))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^" + SEPARATOR[1:]))


def measures(text: Column) -> dict[str, Column]:
    """Whole-text measures by name, each a column of its own; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = word_array(text)
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": let(lines_with_words(text), duplicate_lines),
        "n_repeat_words": let(words, lambda w: repeated_words(w)),
        "n_lines": F.size(lines_with_words(text)),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_bangs": F.regexp_count(text, F.lit("!!")),
    }


def base_measures(text: Column) -> Column:
    """The contract's five measures in one struct, with the words of a text split only once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    named = measures(text)
    rest = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        named["n_symbols"].cast("long").alias("n_symbols"),
        named["n_dup_lines"].cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
    )
    return let(word_array(text), rest)


def base_rules(measure: Measure) -> dict[str, Column]:
    """True where a document fails."""
    return {
        "few_words": measure("n_words") < LEAST_WORDS,
        "repeated_windows": measure("n_repeat_words") * 100 > measure("n_words") * REPEATED_PERCENT,
    }


def further_rules(measure: Measure) -> dict[str, Column]:
    """True where a document fails: symbols, shouting, repeated lines, odd word lengths."""
    return {
        "symbols": measure("n_symbols") * 10 > measure("n_words"),
        "capitals": measure("n_upper") * 10 > measure("word_chars") * 3,
        "exclamations": measure("n_bangs") * 10 > measure("n_words"),
        "repeated_lines": measure("n_dup_lines") * 2 > measure("n_lines"),
        "word_length": (measure("word_chars") < measure("n_words") * 2)
        | (measure("word_chars") > measure("n_words") * 15),
    }


def of_text(text: Column) -> Measure:
    """Measures taken from the text each time a rule asks for one."""
    named = measures(text)
    return lambda name: named[name]


def _sizes(words: Column) -> Column:
    return F.struct(F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"))


def of_words(text: Column, words: Column, sizes: Column) -> Measure:
    """Measures from words and sizes that were taken once; the others from the text when a rule asks for them."""
    named = measures(text)

    def measure(name: str) -> Column:
        if name == "n_repeat_words":
            return repeated_words(words)
        return sizes[name] if name in ("n_words", "word_chars") else named[name]

    return measure


def of_struct(text: Column, taken: Column) -> Measure:
    """The contract's measures from their struct, the others from the text."""
    named = measures(text)
    return lambda name: taken[name] if name in OWN_MEASURES else named[name]


def best_order(sample: DataFrame, rules: Mapping[str, Column], runs: int = 2) -> list[str]:
    """Rule names by rejections per second on the sample, most first; ties keep the given order."""
    total = sample.count()
    if not total:
        return list(rules)

    def seconds(failed: Column) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(runs):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(failed)).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, rejected

    idle, _ = seconds(F.length("text") < 0)
    worth = {}
    for name, failed in rules.items():
        took, rejected = seconds(failed)
        worth[name] = (rejected / total) / max(took - idle, 1e-3)
    return sorted(rules, key=lambda name: -worth[name])


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded number of texts of bounded length, of which only the order of rules depends.

    `take` reads no more partitions than it needs for them, whatever the size of the table.
    """
    text = F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARACTERS)
    return docs.sparkSession.createDataFrame(docs.select(text.alias("text")).take(rows), "text string")


def first_failed(rules: Mapping[str, Column], order: Sequence[str]) -> Column:
    """Name of the first rule a row fails, else null; later rules are not evaluated then."""
    verdict = None
    for name in order:
        verdict = (F if verdict is None else verdict).when(rules[name], F.lit(name))
    return F.lit(None).cast("string") if verdict is None else verdict.otherwise(F.lit(None).cast("string"))


def _whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _further_order(docs: DataFrame) -> list[str]:
    """Order of the further rules by what they cost once the contract's measures are there, where the base rules pass."""
    text = _whole(F.col("text"))
    sample = stage(sample_of(docs).select("text", base_measures(text).alias("taken")), "quality-sample")
    measure = of_struct(text, F.col("taken"))
    passing = sample.filter(first_failed(base_rules(measure), BASE_RULES).isNull())
    return best_order(passing, further_rules(measure))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the rule that rejected the document."""
    text = _whole(F.col("text"))
    order = _further_order(docs)

    def verdict(taken: Column) -> Column:
        measure = of_struct(text, taken)
        base = first_failed(base_rules(measure), BASE_RULES)
        rule = F.coalesce(base, first_failed(further_rules(measure), order))
        return F.struct(taken.alias("m"), base.isNotNull().alias("base_failed"), rule.alias("failed_rule"))

    judged = docs.select(F.col("doc_id"), let(base_measures(text), verdict).alias("v"))
    return judged.select(
        "doc_id",
        *[F.col("v")["m"][n].alias(n) for n in OWN_MEASURES],
        F.col("v")["base_failed"].alias("base_failed"),
        F.col("v")["failed_rule"].isNull().alias("kept"),
        F.col("v")["failed_rule"].alias("failed_rule"),
    )


def _all_rules(measure: Measure) -> dict[str, Column]:
    return base_rules(measure) | further_rules(measure)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    Words are taken from a text once, and the rules run on them in the order that they earn on the sample.
    """
    text = _whole(F.col("text"))
    sample = sample_of(docs).select("text", word_array(text).alias("words"))
    sample = stage(sample.withColumn("sizes", _sizes(F.col("words"))), "quality-sample")
    order = best_order(sample, _all_rules(of_words(text, F.col("words"), F.col("sizes"))))
    cascade = lambda words, sizes: first_failed(_all_rules(of_words(text, words, sizes)), order)
    verdict = let(word_array(text), lambda words: let(_sizes(words), lambda sizes: cascade(words, sizes)))
    name = free_name(docs, "failed_rule")
    return docs.withColumn(name, verdict).filter(F.col(name).isNull()).drop(name)
