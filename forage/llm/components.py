"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forage.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that edges ``a``, ``b`` (long) reach from it.

    Each round takes the smallest label among a node, its neighbours and its
    label's label, so labels travel twice as far every time.  Rounds are
    written down: a lost executor repeats one round at most.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        above = labels.select(F.col("node").alias("up"), F.col("label").alias("far"))
        step = labels.join(near, labels["node"] == near["a"]).join(above, F.col("label") == F.col("up"))
        step = step.select("node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        step = cut(step, "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels
