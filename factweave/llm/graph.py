"""Connected components of an edge table by minimum labels with pointer jumping; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that is reachable.

    The minimum over a node's neighbours is pre-aggregated before its shuffle, so a hub is no hot group there; where
    labels are joined to a hub's edges, the join is one that adaptive execution can split. An empty table gives an
    empty result. Each round at least halves the length of a chain of labels.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        offers = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(offers, "node", "left").select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        step = lower.join(up, "low", "left").select("node", F.least("low", "jump").alias("comp"), (F.least("low", "jump") < F.col("comp")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("node", "comp")
        if step.where("moved").isEmpty():
            return labels
