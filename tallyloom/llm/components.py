"""Connected components of an edge table, by smallest-label exchange and pointer jumping; nothing is brought to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): label is the smallest node that it is linked with, over any number of links."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        ends = labels.select(F.col("node").alias("end"), F.col("label").alias("beyond"))
        jumped = cut(step.join(ends, F.col("to") == F.col("end"), "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("label"), "was"))
        moved = jumped.where(F.col("label") < F.col("was")).limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels
