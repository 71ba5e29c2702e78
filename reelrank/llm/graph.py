"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Every round takes the smallest label around each node and then the label of that label, so the
    rounds grow with the logarithm of a component's width.  Labels are written each round.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(
        F.col("a").alias("node"), "label"))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around.select(F.col("a").alias("node"), "near"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.save(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        moved = new.filter(F.col("old") != F.col("label")).limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "label")
        labels._scratch_path = new._scratch_path
        if not moved:
            scratch.drop(both)
            return labels.select("node", F.col("label").alias("component"))
