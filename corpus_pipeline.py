"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes the session, its documents and the folder of the given tables; what it returns is
written as Parquet and read again as the documents of the next one. What a stage stored on the way is
removed once its result is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import decontamination, packing, quality_rules, simhash, substring_dedup
from hirelake.llm.queries import CAPACITY, PACKING_END, VOCABULARY
from hirelake.llm.tokens import public_vocabulary
from hirelake.sources.staging import stage_alone

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of 20 words or more that also stand earlier."""
    return substring_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences.

    Python workers that served earlier stages are still there, so this one remembers fewer pieces.
    """
    return packing.pack(docs, public_vocabulary(VOCABULARY), CAPACITY, PACKING_END, remember=150_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", span_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Fingerprints, suffix automata and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage_alone(spark, name, partial(function, spark, docs, sf_dir))
    return docs
