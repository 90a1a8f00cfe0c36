"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, gathered


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Link neighbours of each node to the least node near it.

    ``edges`` has columns u > v. The large star moves the larger neighbours, the small
    star the smaller ones. Least neighbours are partial aggregates and a join brings
    them back, so a node with very many neighbours is never gathered in one task.
    There are at most ``most`` edges, and as many tasks as they need.
    """
    both = gathered(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * most) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return gathered(gathered(out.where("u > v"), 2 * most).distinct(), 2 * most)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the least node.

    Nulls and loops are dropped. Rounds double the reach of every root, so their number
    follows the logarithm of the longest path. Every round is cut by a checkpoint.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = edges.agg(*digest).first()
    edges = gathered(edges, before[0])
    for _ in range(rounds):
        if not before[0]:
            break
        edges = checkpointed(_star(_star(edges, True, before[0]), False, before[0]))
        after = edges.agg(*digest).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
