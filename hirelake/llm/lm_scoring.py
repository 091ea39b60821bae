"""Stupid-backoff scores of whole documents from bigram counts of all other documents.

Counts are leave-one-out: c(x) is how often x occurs in the corpus less how often in the document that
is scored, N the number of tokens of all other documents. So a bigram that only this document holds is
unseen, and S(w | v) = c(v w) / c(v) where the bigram is left `least_count` times, else alpha * c(w) / N; the
first token of a document has c(w) / N. A token that no other document holds counts as alpha
occurrences, and N as 1 at least. A document's score is the sum of log10 S over its tokens.

Counts are kept in tables: unigrams, at most as many as the vocabulary has ids, and bigrams, summed
within each task before they are partitioned by hash. Documents are exploded to their distinct
bigrams with multiplicities and the two terms that unigrams decide, left-joined to the counts, and summed. Bigrams that
make up at least one in 2^20 of all are at most 2^20 in number; these go to every task, so a frequent bigram is scored where
it is read and only rare ones are shuffled, each of which is too rare to be a hot key.

Defined results: a null or empty text has no token, a score of 0 and a null score per token; repeated
rows are documents of their own, which see each other, and so are rows with a null doc_id; an empty table gives
no row. Every text counts in full, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.tokens import encoder, id_bound, share_vocabulary
from hirelake.sources.staging import stage

ALPHA = 0.4
LEAST_COUNT = 1
FREQUENT_SHARE = 1 << 20
REMEMBER = 600_000  # pieces of text; the same Python workers count and score afterwards
COUNTED_AT_ONCE = 1_000_000  # tokens sorted at a time
_COUNTS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_OPEN = "row long, gram long, times long, unseen double, context double"


def _kind(bound: int) -> str:
    """How ids below `bound` are stored."""
    return "<u2" if bound <= 1 << 16 else "<u4"


def _grams(ids: np.ndarray, bound: int) -> np.ndarray:
    wide = ids.astype(np.int64)
    return wide[:-1] * bound + wide[1:]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values of several count tables with their sums."""
    values, counts = (np.concatenate(c) for c in zip(*parts))
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def _tokens(docs: DataFrame, vocabulary: str, bound: int) -> DataFrame:
    """row, doc_id and ids as unsigned numbers, written once."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        for batch in batches:
            ids = [x.astype(_kind(bound)).tobytes() for x in encoder(shared, REMEMBER).encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(ids, pa.binary())], ["row", "doc_id", "ids"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return stage(rows.mapInArrow(run, "row long, doc_id long, ids binary"), "tokens")


def _counts(tokens: DataFrame, bound: int) -> DataFrame:
    """gram, n: bigram counts, and unigram counts under -1 - id, summed within each batch of documents."""

    def run(batches):
        for batch in batches:
            each = [np.frombuffer(x, _kind(bound)) for x in batch.column("ids").to_pylist()]
            group = np.cumsum([len(x) for x in each]) // COUNTED_AT_ONCE
            parts = []
            for g in np.unique(group).tolist():
                a, b = np.searchsorted(group, [g, g + 1]).tolist()
                ids = np.concatenate(each[a:b])
                parts.append(np.unique(-1 - ids.astype(np.int64), return_counts=True))
                parts.append(np.unique(np.concatenate([_grams(x, bound) for x in each[a:b]]), return_counts=True))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(parts)], schema=_COUNTS)

    partial = tokens.select("ids").mapInArrow(run, "gram long, n long")
    return stage(partial.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")


def count_tables(tokens: DataFrame, bound: int) -> tuple[np.ndarray, DataFrame]:
    """Counts of all ids as a dense array, and the table of bigrams."""
    counted = _counts(tokens, bound)
    single = counted.filter("gram < 0").toPandas()  # at most one row for each id of the vocabulary
    unigrams = np.zeros(bound, np.int64)
    unigrams[-1 - single["gram"].to_numpy(np.int64)] = single["n"].to_numpy(np.int64)
    return unigrams, counted.filter("gram >= 0")


def score(docs: DataFrame, vocabulary: str, alpha: float = ALPHA, least_count: int = LEAST_COUNT, share: int = FREQUENT_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_unseen (bigrams backed off from), log10_score and log10_per_token of every row."""
    spark = docs.sparkSession
    bound = id_bound(vocabulary)
    tokens = _tokens(docs, vocabulary, bound)
    unigrams, bigrams = count_tables(tokens, bound)
    total, least_count = int(unigrams.sum()), max(1, least_count)
    frequent = bigrams.filter(F.col("n") >= max(1, -(-total // share))).toPandas().sort_values("gram")
    hot, hot_n = frequent["gram"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((unigrams, hot, hot_n))

    def scored(ids: np.ndarray):
        """Distinct bigrams the task cannot score, with multiplicities, unseen terms and contexts; the rest's score and unseen bigrams."""
        unigrams, hot, hot_n = shared.value
        base = np.log10(max(total - len(ids), 1))
        held, times = np.unique(ids, return_counts=True)
        left = unigrams[held] - times
        words = np.log10(np.maximum(left, alpha)) - base
        own, n = np.unique(_grams(ids, bound), return_counts=True)
        first, last = (np.searchsorted(held, part) for part in (own // bound, own % bound))
        unseen = np.log10(alpha) + words[last]
        context = np.log10(np.maximum(left[first], 1))
        at = np.minimum(np.searchsorted(hot, own), max(len(hot) - 1, 0))
        here = hot[at] == own if len(hot) else np.zeros(len(own), bool)
        rest = hot_n[at[here]] - n[here]
        seen = rest >= least_count
        terms = np.where(seen, np.log10(np.maximum(rest, 1)) - context[here], unseen[here])
        done = float(terms @ n[here]) + (float(words[np.searchsorted(held, ids[0])]) if len(ids) else 0.0)
        return (own[~here], n[~here], unseen[~here], context[~here]), done, int(n[here][~seen].sum())

    def run(batches):
        for batch in batches:
            parts = []
            for row, raw in zip(batch.column("row").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(raw, _kind(bound))
                (own, n, unseen, context), done, off = scored(ids)
                # A closing row holds the tokens, the score so far and the bigrams backed off from.
                ends = ((own, -1), (n, len(ids)), (unseen, done), (context, float(off)))
                parts.append((np.full(len(own) + 1, row, np.int64), *(np.append(x, end) for x, end in ends)))
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "gram", "times", "unseen", "context"])

    exploded = tokens.select("row", "ids").mapInArrow(run, _OPEN)
    open_, closed = exploded.filter("gram >= 0"), exploded.filter("gram < 0")
    joined = open_.join(bigrams, "gram", "left").withColumn("rest", F.col("n") - F.col("times"))
    seen = F.col("rest") >= least_count
    term = F.when(seen, F.log10("rest") - F.col("context")).otherwise(F.col("unseen"))
    none = F.lit(0).cast("bigint")
    off = F.when(seen, none).otherwise(F.col("times"))
    sums = joined.select("row", (F.col("times") * term).alias("term"), none.alias("tokens"), off.alias("off"))
    ends = closed.select("row", F.col("unseen").alias("term"), F.col("times").alias("tokens"), F.col("context").cast("bigint").alias("off"))
    scored_rows = sums.unionByName(ends).groupBy("row").agg(
        F.sum("term").alias("log10_score"), F.sum("tokens").alias("n_tokens"), F.sum("off").alias("n_unseen")
    )
    whole = tokens.select("row", "doc_id").join(scored_rows, "row")
    per_token = F.when(F.col("n_tokens") > 0, F.col("log10_score") / F.col("n_tokens"))
    rounded = lambda c: F.round(c, 6)  # noqa: E731  sums of doubles differ in their last digits by order
    return whole.select(
        "doc_id", "n_tokens", "n_unseen", rounded(F.col("log10_score")).alias("log10_score"), rounded(per_token).alias("log10_per_token")
    )
