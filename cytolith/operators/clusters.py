"""Cluster agreement, composition and edges between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.operators.annotation import shares


def majority(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """The commonest label of each cluster (ties by name) and its share."""
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), label)
    return shares(df.where(F.col(label).isNotNull()), cluster, label).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def purity(df: DataFrame, cluster: str, label: str, keep_null: bool = False) -> DataFrame:
    """Rows of the commonest label of their cluster, over all rows; a null is a label of its own if kept, else no row."""
    counts = (df if keep_null else df.where(F.col(label).isNotNull())).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(cluster).agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg((F.sum("most") / F.sum("n")).alias("purity"))


def entropy(df: DataFrame, cluster: str, label: str, keep_null: bool = False) -> DataFrame:
    """Mean entropy of labels within clusters, weighted by size, over the log of the number of labels; null below two.

    A null is a label of its own if kept, else no row.
    """
    labelled = df if keep_null else df.where(F.col(label).isNotNull())
    mixed = shares(labelled, cluster, label).groupBy(cluster).agg(F.sum("n").alias("n"), (-F.sum(F.col("share") * F.ln("share"))).alias("h"))
    labels = labelled.agg((F.count_distinct(label) + F.coalesce(F.max(F.col(label).isNull().cast("int")), F.lit(0))).alias("labels"))
    total = mixed.agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("h"))
    return total.join(F.broadcast(labels)).select(F.when(F.col("labels") >= 2, F.col("h") / F.ln("labels")).alias("entropy"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings; null for fewer than two rows or no room for agreement."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    joint = cells.agg(two.alias("joint"), F.sum("n").alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two.alias("by_a"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two.alias("by_b"))
    pairs = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("by_a") * F.col("by_b") / pairs
    room = (F.col("by_a") + F.col("by_b")) / 2 - expected
    value = F.when((F.col("total") >= 2) & (room != 0), (F.col("joint") - expected) / room)
    return joint.join(F.broadcast(rows)).join(F.broadcast(columns)).select(value.alias("ari"))


def knn_edges(neighbours: DataFrame) -> DataFrame:
    """Edges with weights that fall with distance, loops left out."""
    return neighbours.where("from_id <> to_id").select("from_id", "to_id", (1 / (1 + F.col("distance"))).alias("weight"))
