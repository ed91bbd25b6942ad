"""Connected components of an edge table, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges(a, b), both long."""
    both = scratch.materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        # the least label among the neighbours, and then the label of that label
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jumped = hooked.join(labels.select(F.col("node").alias("to"), F.col("label").alias("beyond")), "to", "left").select("node", "old", F.least("to", F.coalesce("beyond", "to")).alias("label"))
        step = scratch.materialise(jumped, f"{name}-labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
