"""Rendezvous hashing of record keys over weighted shards.

A key goes to the shard with the highest score ln(u) / weight, where u in (0, 1) comes from the hash
of key and shard number. A score depends on its own shard alone, so one more shard takes records only
into itself, and about its share of them; no other record moves. Placing a row needs no other row.

Defined results: a null key is a key of its own; a null text has no bytes; equal keys share a shard.
Slots follow the key order within the shard, and ties of it the order of size and checksum; repeated rows
take a slot each. A text counts whole, however long. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.ordering import sequential_id
from hirelake.sources.staging import stage

_DIGITS = 13  # hexadecimal digits of the hash: 52 bits, which a double holds exactly


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; weights[s] is the share that shard s asks for, relative to the others."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scored = []
    for shard, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(name, F.lit(f"/{shard}"))), 1, _DIGITS)
        uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        scored.append(F.struct((F.ln(uniform) / weight).alias("score"), F.lit(-shard).alias("shard")))
    return -F.greatest(*scored)["shard"] if len(scored) > 1 else F.lit(0)


def place(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, shard under `weights` and grown_shard under `grown`, row by row."""
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), grown).cast("int").alias("grown_shard"),
    )


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 in key order, by one range sort over all shards.

    Only the narrow rows are sorted; the shard sizes are one number per shard.
    """
    order = ["shard", "doc_id", "size", "text_crc32"]
    numbered = sequential_id(stage(placed, "placed"), order, ["row_number"])
    sizes = numbered.groupBy("shard").agg(F.min("row_number").alias("first_row"))
    rows = numbered.join(F.broadcast(sizes), "shard")  # as many rows as there are shards
    return rows.withColumn("slot", (F.col("row_number") - F.col("first_row")).cast("long")).drop("row_number", "first_row")
