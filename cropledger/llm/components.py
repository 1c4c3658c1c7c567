"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropledger.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Every round takes the smallest label among the neighbours, then the label of that label, and is written to the shared
    folder. Aggregates combine in the map tasks, and joins on a node with many edges can be split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    both = both.union(labels.select(F.col("node").alias("a"), F.col("node").alias("b")))  # a node's own label is one of those around it
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
        lower = near.agg(F.min("root").alias("low"), F.min(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("root"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = materialize(lower.join(jump, "low").select("node", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("changed")), "labels")
        labels = step.select("node", "root")
        if not step.where("changed").limit(1).count():
            return labels
