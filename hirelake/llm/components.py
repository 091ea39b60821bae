"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.sources.staging import stage

MAX_ROUNDS = 100
BROADCAST_EDGES = 100_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Link neighbours of each node u to the least of them and u: the larger ones, or the smaller ones and u.

    Links of large groups name few nodes, so their files say little of the rows; unless there are few
    of them, they are joined by shuffle.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = pairs.join(least if few else least.hint("merge"), "a")
    if large:
        moved = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node it reaches, for every node of the links (bigint columns a and b).

    Each round links nodes to ever smaller ones, first from above and then from below; the number of
    rounds grows with the logarithm of the longest chain. Every round is a written table, so a lost
    executor costs one round at most. A group's least node comes from a map-side minimum; joins on
    a node with many links are left to adaptive skew handling, as the other side has one row for it.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = stage(down.distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        few = mark[0] <= BROADCAST_EDGES  # neither step makes more than twice as many
        edges = stage(_star(stage(_star(edges, True, few), "links"), False, few), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
