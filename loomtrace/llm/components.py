"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm._common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reached.

    Each round takes the least label among a node and its neighbours, then the label's own label,
    so long chains halve. Every round is written, hence a lost executor costs one round. Edges of a
    node are pre-aggregated before the exchange; loops and repeated edges do no harm.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = stored(step.join(up, "label", "left").select("node", "old", F.least("label", "top").alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
