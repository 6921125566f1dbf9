"""Connected components of an edge list, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component (the smallest node of its component) of every node of edges (columns a and b, longs).

    Each round gives a node the smallest label among its own, its neighbours' and its label's label, so chains shrink
    to their logarithm. Joins and minima only: a hub with many neighbours is one row on the other side of a join that
    adaptive execution can split. Every round is written to the shared folder. No edges give no rows.
    """
    both = common.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        found = common.stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        if found.filter("old <> label").isEmpty():
            break
        labels = found.select("node", "label")
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    return found.select("node", F.col("label").alias("component"))
