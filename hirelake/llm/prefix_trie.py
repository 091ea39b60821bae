"""The trie of conversations that start alike, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns; the root is the empty one. A prefix is told by 128 bits: each
turn's role and text, hashed together with its position, are combined by exclusive or along the
conversation, so prefixes come from running values of bounded chunks of a conversation, however long it is.
With n nodes two of them share these bits with a probability of about n^2 / 2^129.

Subtree totals come from contraction. Every round first splices unary nodes out of their chains (compress):
those that rank below both neighbours, the rank being the power of two in their depth, then a hash, so at least every
second node of an untouched chain goes. Then it removes all leaves (rake), whose totals
are known, and adds them to their parents. A round is two shuffles of fixed-width rows, summed in each
task first, so a node with any number of children is one row per task; what is left is written and
halves or better, so the rounds grow with the logarithm of the nodes. Re-expansion walks the rounds back: a
spliced node's total is its own sum plus the total of the child that it was spliced in front of.

Defined results: null roles and texts count as empty; turns are ordered by `turn`, null first, equal ones by a
hash of role and text, so repeated rows are turns of their own; rows without conv_id belong to no conversation; an empty table gives
the root alone, without members. Further columns are not read. Texts enter only by hash and size, whatever their length.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.operators.ordering import sequential_id
from hirelake.operators.skew import heavy_keys, left_join_default
from hirelake.sources.staging import stage

CHUNK = 4096  # turns of a conversation that one running value goes over
IDS_AT_ONCE = 100_000  # ids that are joined to one string
MAX_ROUNDS = 200
NOBODY = hashlib.sha256().hexdigest()
_ID = ("k1", "k2")
_PARENT = ("p1", "p2")
_CHILD = ("c1", "c2")
_KINDS = ALIVE, RAKED, SPLICED = 0, 1, 2


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), of (turns of the conversation), t1, t2 (128 bits of role and text), n_bytes.

    Turns are numbered by a range sort, so a conversation of any share of all rows is spread over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).filter("conv_id IS NOT NULL")
    numbered = stage(sequential_id(rows, ["conv_id", "turn", "t1", "t2"], ["number"]), "trie-turns")
    first = numbered.groupBy("conv_id").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("of"))
    heavy = heavy_keys(numbered, {"conv": ["conv_id"]})["conv"]
    placed = left_join_default(numbered, first, ["conv_id"], heavy=heavy, salt_by=["number"])
    return placed.select("conv_id", (F.col("number") - F.col("first") + 1).alias("position"), "of", "t1", "t2", "n_bytes")


def _running(turns: DataFrame) -> DataFrame:
    """Turns with k1, k2, the bits of the prefix that ends here, and p1, p2, those of the one before."""
    chunk = F.floor((F.col("position") - 1) / CHUNK).cast("bigint")
    m1 = F.xxhash64(F.col("position"), F.col("t1"), F.col("t2"))
    m2 = F.xxhash64(-F.col("position"), F.col("t2"), F.col("t1"))
    marked = turns.withColumns({"chunk": chunk, "m1": m1, "m2": m2})
    within = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumns({"x1": F.bit_xor("m1").over(within), "x2": F.bit_xor("m2").over(within)})
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = marked.groupBy("conv_id", "chunk").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    starts = chunks.select("conv_id", "chunk", F.bit_xor("m1").over(before).alias("s1"), F.bit_xor("m2").over(before).alias("s2"))
    starts = starts.filter("chunk > 0")
    joined = inside.join(starts, ["conv_id", "chunk"], "left")
    for i in "12":
        key = F.col(f"x{i}").bitwiseXOR(F.coalesce(F.col(f"s{i}"), F.lit(0).cast("bigint")))
        joined = joined.withColumn(f"k{i}", key).withColumn(f"p{i}", key.bitwiseXOR(F.col(f"m{i}")))
    return joined.select("conv_id", "position", "of", "n_bytes", *_ID, *_PARENT)


def _nodes(prefixes: DataFrame, turnless: DataFrame) -> DataFrame:
    """One row per node: its bits, depth, parent's bits, conv_id, n_convs and n_bytes of its last turn; the root included."""
    below = prefixes.groupBy(*_ID).agg(
        F.min("position").alias("depth"),
        *[F.min(c).alias(c) for c in (*_PARENT, "n_bytes", "conv_id")],
        F.count(F.lit(1)).alias("n_convs"),
    )
    members = prefixes.filter("position = 1").select("conv_id").unionByName(turnless.select("conv_id"))
    zero = lambda name: F.lit(0).cast("bigint").alias(name)
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    none = [F.lit(None).cast("bigint").alias(c) for c in _PARENT]
    return below.unionByName(root.select(*map(zero, _ID), zero("depth"), *none, zero("n_bytes"), "conv_id", "n_convs"))


def _ends(prefixes: DataFrame, turnless: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: of the ids of the conversations that end at a node, in order, joined by commas.

    Ids are sorted over many tasks, which join runs of them; one task puts the runs of a node together one by one,
    as the hash goes along them, and holds a single run at a time.
    """

    def runs(batches):
        key, first, ids, made, size = None, None, [], [], 0

        def joined():
            rows = list(zip(*made))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], [*_ID, "first", "ids"])

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k1, k2) != key or len(ids) == IDS_AT_ONCE:
                    if ids:
                        made.append((*key, first, ",".join(ids)))
                        size += len(ids)
                    if size >= IDS_AT_ONCE:
                        yield joined()
                        made, size = [], 0
                    key, first, ids = (k1, k2), conv, []
                ids.append(str(conv))
        if ids:
            made.append((*key, first, ",".join(ids)))
        if made:
            yield joined()

    def hashes(batches):
        key, running, done = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) == key:
                    running.update(b"," + ids.encode())
                else:
                    if key:
                        done.append((*key, running.hexdigest()))
                    key, running = (k1, k2), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*_ID, "ends_sha256"])
                done = []
        if key:
            yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [running.hexdigest()]})

    at_root = turnless.select(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv_id")
    ends = prefixes.filter("position = of").select(*_ID, "conv_id").unionByName(at_root)
    order = [*_ID, "conv_id"]
    sorted_ends = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    joined = sorted_ends.mapInArrow(runs, "k1 long, k2 long, first long, ids string")
    dealt = joined.repartition(*_ID).sortWithinPartitions(*_ID, "first")
    return dealt.mapInArrow(hashes, "k1 long, k2 long, ends_sha256 string")


def _rows(*rows: dict[str, Column], when: tuple[Column, ...]) -> Column:
    """One output row of the same fields for each of `rows` whose condition holds."""
    fields = sorted({name for row in rows for name in row})
    empty = F.lit(None).cast("bigint")
    made = [
        F.when(condition, F.struct(*[row.get(f, empty).cast("bigint").alias(f) for f in fields]))
        for row, condition in zip(rows, when)
    ]
    return F.inline(F.filter(F.array(*made), lambda r: r.isNotNull()))


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def _below(depth: str, bits: tuple[str, str]) -> Column:
    """Whether a node ranks below that of another depth and other bits; a rank is for all rounds."""
    power = lambda d: F.col(d).bitwiseAND(-F.col(d))
    chance = lambda b: F.xxhash64(*b)
    same = (power("depth") == power(depth)) & (chance(_ID) < chance(bits))
    # The root has no power of two in its depth and is never spliced, so all rank below it.
    return (F.col(depth) == 0) | (power("depth") < power(depth)) | same


def _spliced(alive: DataFrame, first: bool) -> DataFrame:
    """Alive nodes and messages to their parents, with spliced nodes taken out of their chains."""
    known = alive.groupBy(*_ID).agg(
        *[F.max(c).alias(c) for c in ("depth", *_PARENT, "parent_depth")],
        *[F.max(c).alias(c) for c in (*_CHILD, "child_depth")],
        *map(_sum, ("children", "leaves", "saved")),
    )
    if first:
        known = known.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint"))
    unary = (F.col("children") == 1) & (F.col("depth") > 0)
    out = unary & _below("parent_depth", _PARENT) & _below("child_depth", _CHILD)
    known = known.withColumn("out", out)
    itself = _cols(*_ID, "depth", *_PARENT, "parent_depth", *_CHILD, "children", "leaves", "saved")
    itself["kind"] = F.when(F.col("out"), SPLICED).otherwise(ALIVE)
    to_parent = {"k1": F.col("p1"), "k2": F.col("p2"), "leaves": F.col("leaves"), "saved": F.col("saved")}
    to_child = {"k1": F.col("c1"), "k2": F.col("c2"), "new_p1": F.col("p1"), "new_p2": F.col("p2"), "new_depth": F.col("parent_depth")}
    sent = known.select(_rows(itself, to_parent, to_child, when=(F.lit(True), F.col("out"), F.col("out"))))
    return sent.groupBy(*_ID).agg(
        *[F.max(c).alias(c) for c in ("kind", "depth", *_CHILD, "children")],
        *[F.coalesce(F.max(f"new_{c}"), F.max(c)).alias(c) for c in _PARENT],
        F.coalesce(F.max("new_depth"), F.max("parent_depth")).alias("parent_depth"),
        *map(_sum, ("leaves", "saved")),
    )


def _next(contracted: DataFrame) -> DataFrame:
    """What is left after a round, as messages that the next one adds up."""
    alive, raked = F.col("kind") == ALIVE, F.col("kind") == RAKED
    itself = _cols(*_ID, "depth", *_PARENT, "parent_depth", "leaves", "saved")
    as_child = {
        "k1": F.col("p1"), "k2": F.col("p2"), "c1": F.col("k1"), "c2": F.col("k2"),
        "child_depth": F.col("depth"), "children": F.lit(1),
    }
    total = {"k1": F.col("p1"), "k2": F.col("p2"), "leaves": F.col("leaves"), "saved": F.col("saved")}
    left = contracted.filter(F.col("kind") != SPLICED)
    return left.select(_rows(itself, as_child, total, when=(alive, alive & (F.col("depth") > 0), raked & (F.col("depth") > 0))))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """k1, k2, leaves and saved of every node: childless nodes, and the sums of `own`, in its subtree.

    `nodes` has k1, k2, depth, p1, p2 and own; the root has depth 0 and no parent.
    """
    start = nodes.select(
        *_ID, "depth", *_PARENT, (F.col("depth") - 1).alias("parent_depth"),
        F.lit(0).cast("bigint").alias("leaves"), F.col("own").alias("saved"), F.lit(ALIVE).alias("kind"),
    )
    rounds: list[tuple[DataFrame, int]] = []
    for _ in range(MAX_ROUNDS):
        spliced = _spliced(_next(rounds[-1][0] if rounds else start), not rounds)
        raked = (F.col("kind") == ALIVE) & (F.col("children") == 0)
        done = stage(spliced.withColumn("kind", F.when(raked, RAKED).otherwise(F.col("kind"))), "trie-round")
        counts = done.groupBy("kind").count().collect()
        of = {r["kind"]: r["count"] for r in counts}
        rounds.append((done, of.get(SPLICED, 0)))
        if not of.get(ALIVE):
            break
    else:
        raise RuntimeError(f"the trie was not contracted in {MAX_ROUNDS} rounds")
    totals: list[DataFrame] = []
    for done, spliced in reversed(rounds):
        totals.append(done.filter(F.col("kind") == RAKED).select(*_ID, "leaves", "saved"))
        if spliced:
            known = reduce(DataFrame.unionByName, totals).withColumnsRenamed({"k1": "c1", "k2": "c2", "leaves": "below", "saved": "more"})
            chains = done.filter(F.col("kind") == SPLICED).join(known, list(_CHILD))
            own = chains.select(*_ID, (F.col("leaves") + F.col("below")).alias("leaves"), (F.col("saved") + F.col("more")).alias("saved"))
            totals.append(stage(own, "trie-chains"))
    return reduce(DataFrame.unionByName, totals)


def trie(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` is as `digested` gives it; `turnless` has the conv_id of every conversation without a turn, a member of the root alone.
    `saved_tokens` sums, over a subtree, what the members but one spare by sharing a node: the bytes of its last text.
    """
    prefixes = stage(_running(turns), "trie-prefixes")
    nodes = _nodes(prefixes, turnless).withColumn("own", F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("n_bytes"))
    nodes = stage(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = nodes.join(subtree_totals(nodes), list(_ID)).join(children, list(_ID), "left").join(_ends(prefixes, turnless), list(_ID), "left")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    heavy = heavy_keys(nodes, {"parent": list(_PARENT)})["parent"]
    whole = left_join_default(whole, parents, list(_PARENT), null_safe=False, heavy=heavy, salt_by=list(_ID))
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )
