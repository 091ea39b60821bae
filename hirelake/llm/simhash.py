"""SimHash near-duplicates: fingerprints within a few bits, found by deletion variants.

With at most k differing bits, k // 2 + 1 segments suffice: one of them differs by one bit at most. So a
fingerprint is indexed by each segment as it is and with one bit left out in turn; two fingerprints within
k bits share such a variant. An equality join finds them and the whole fingerprints are compared inside
it. A bucket that many distinct fingerprints share is cut again by the bits that its variant leaves
open, until no bucket is large, so no group is paired with itself. Equal fingerprints are one node.

Defined results: a text without words has fingerprint zero and is linked like any other; a null doc_id
belongs to its group, and a group without any doc_id has a null component_id; repeated rows are
returned as often as they occur; no document gives no row. All words of a text count, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.components import components
from hirelake.llm.fingerprints import as_hex, fingerprint
from hirelake.llm.text import free_name
from hirelake.operators.ordering import dedupe
from hirelake.operators.skew import heavy_keys, left_join_default
from hirelake.sources.staging import stage

ALL = (1 << 64) - 1
LARGEST_BUCKET = 256
FEW_BITS = 8
BROADCAST_ROWS = 1_000_000


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def segments(rest: int, parts: int) -> list[int]:
    """Masks of `parts` runs of the set bits of `rest`, of nearly equal size."""
    bits = [b for b in range(64) if rest >> b & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def variants(rest: int, left: int) -> list[tuple[int, int, int, int]]:
    """(bits to compare, bit that must differ, bits still open, bits they may differ in).

    Any two values that differ in at most `left` bits of `rest` agree in one of them: they are
    equal on a segment, or differ in the one bit of it that is left out. For segment t the
    earlier ones differ in two bits each at least, so late segments need no bit left out. A
    budget of one bit over many bits takes two halves, one of which must be equal.
    """
    if left == 1 and rest.bit_count() > FEW_BITS:
        return [(half, 0, rest & ~half, 1) for half in segments(rest, 2)]
    found = []
    for t, segment in enumerate(segments(rest, min(left // 2 + 1, max(1, rest.bit_count())))):
        found.append((segment, 0, rest & ~segment, left))
        if left - 2 * t >= 1:
            one = [1 << b for b in range(64) if segment >> b & 1]
            found += [(segment & ~bit, bit, rest & ~segment, left - 1) for bit in one]
    return found


def _spread(rows: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """Every row under each of its variants; `kinds` are the (rest, left) that occur."""
    options = None
    for rest, left in kinds:
        each = F.array(
            *[
                F.struct(
                    F.col("care").bitwiseOR(F.lit(_signed(care))).alias("care"),
                    F.col("must").bitwiseOR(F.lit(_signed(must))).alias("must"),
                    F.lit(_signed(open_)).alias("rest"),
                    F.lit(still).alias("left"),
                )
                for care, must, open_, still in variants(rest, left)
            ]
        )
        here = (F.col("rest") == _signed(rest)) & (F.col("left") == left)
        options = (F if options is None else options).when(here, each)
    spread = rows.select("value", F.explode(options).alias("v")).select("value", "v.*")
    return spread.withColumn("key", F.col("value").bitwiseAND(F.col("care")))


def close_pairs(values: DataFrame, max_bits: int, largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """a, b: pairs of the distinct bigint `value`s that differ in at most `max_bits` bits.

    Pairs may repeat. Buckets of one value are dropped; those up to `largest_bucket` are joined with
    themselves and compared inside the join; larger ones are cut further by their open bits. No join
    here takes its rows through the driver, whatever Spark makes of their size.
    """
    start = {"care": F.lit(0), "must": F.lit(0), "rest": F.lit(_signed(ALL)), "left": F.lit(max_bits)}
    rows = values.select("value").withColumns({k: v.cast("int" if k == "left" else "bigint") for k, v in start.items()})
    kinds, links = [(ALL, max_bits)], None
    bucket = ["care", "must", "key"]
    while kinds:
        spread = _spread(rows, kinds)
        sizes = spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        # Spark sizes what is exploded by the rows before, and would send all of it to the driver.
        live = stage(spread.join(sizes.hint("merge"), bucket), "buckets")
        found = stage(_within(live.filter(F.col("size") <= largest_bucket), bucket, max_bits), "pairs")
        links = found if links is None else links.unionByName(found)
        large = live.filter((F.col("size") > largest_bucket) & (F.col("rest") != 0))
        closed = live.filter((F.col("size") > largest_bucket) & (F.col("rest") == 0))
        links = links.unionByName(_within(closed, bucket, max_bits))
        rows = large.select("value", "care", "must", "rest", "left").distinct()
        kinds = [(r["rest"] & ALL, r["left"]) for r in rows.select("rest", "left").distinct().collect()]
    return links


def _within(live: DataFrame, bucket: list[str], max_bits: int) -> DataFrame:
    left = live.select(*bucket, F.col("value").alias("a"))
    right = live.select(*bucket, F.col("value").alias("b")).withColumnsRenamed({c: f"_{c}" for c in bucket})
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits)
    same = [F.col(c) == F.col(f"_{c}") for c in bucket]
    same_one = differ.bitwiseAND(F.col("must")) == F.col("must")
    # Rows of a bucket stand together, so their files are far smaller than the rows in memory.
    return left.join(right.hint("merge"), [*same, near, same_one]).select("a", "b")


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """Add root, the node of the row's group, and component_id to rows with doc_id and value."""
    nodes = stage(prints.groupBy("value").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(close_pairs(nodes, max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "value"), "value", "left")
    rooted = stage(rooted.withColumn("root", F.coalesce("root", "value")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("value", "root").join(least, "root")
    heavy = heavy_keys(prints, {"value": ["value"]})["value"]
    return left_join_default(prints, named, ["value"], null_safe=False, heavy=heavy)


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id reachable over links, itself included."""
    prints = docs.select("doc_id", fingerprint(F.col("text").cast("string"), size).alias("value"))
    grouped = _grouped(stage(prints, "fingerprints"), max_bits)
    return grouped.select("doc_id", as_hex(F.col("value")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, max_bits: int = 2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns.

    A document is told by doc_id and text here: of rows that agree in both one stays, and a row
    without doc_id stays only if its group has no other.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    prints = docs.select("doc_id", text_hash.alias("hash"), fingerprint(F.col("text").cast("string"), size).alias("value"))
    grouped = stage(_grouped(stage(prints, "fingerprints"), max_bits), "groups")
    told = grouped.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")
    first = grouped.groupBy("root").agg(F.min(order).alias("first"))
    heavy = heavy_keys(told, {"root": ["root"]})["root"]
    placed = left_join_default(told, first, ["root"], null_safe=False, heavy=heavy)
    judged = stage(placed.withColumn("stays", F.col("first") == order), "judged")
    drop = judged.filter(~F.col("stays")).select(F.col("doc_id").alias("drop_id"), F.col("hash").alias("drop_hash"))
    again = judged.filter(F.col("stays") & (F.col("copies") > 1))
    again = again.select(F.col("doc_id").alias("drop_id"), F.col("hash").alias("drop_hash"))
    name = free_name(docs, "text_hash")
    hashed = docs.withColumn(name, text_hash)
    kept = _matching(hashed, drop, name, "left_anti", broadcast_rows)
    if not again.isEmpty():
        repeated = _matching(kept, again, name, "left_semi", broadcast_rows)
        rest = [c for c in hashed.columns if c not in ("doc_id", name)]
        single = dedupe(repeated, ["doc_id", name], rest)
        kept = _matching(kept, again, name, "left_anti", broadcast_rows).unionByName(single)
    return kept.drop(name)


def _matching(docs: DataFrame, ids: DataFrame, name: str, how: str, broadcast_rows: int) -> DataFrame:
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    renamed = {c: free_name(docs, c) for c in ids.columns}
    ids = ids.withColumnsRenamed(renamed)
    same: Column = docs["doc_id"].eqNullSafe(ids[renamed["drop_id"]]) & (docs[name] == ids[renamed["drop_hash"]])
    return docs.join(ids, same, how)
