"""Connected components of an edge table: least labels, with the labels' own labels followed in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node it reaches) of every node of ``edges``; each round at least halves the way to it on a chain of labels.

    Every round reads and writes tables of the size of the edges; none of them passes through the driver.
    """
    both = materialize(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct())
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("then"))
        after = materialize(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("then", "low")).alias("new"), "component"))
        labels = after.select("node", F.col("new").alias("component"))
        if after.where("new <> component").isEmpty():
            return labels
