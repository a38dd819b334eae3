"""Connected components of a large graph by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """The smallest reachable node of every node that has an edge.

    ``edges`` has ``a, b``; repeats and loops do no harm.  Each round takes the smallest label among the neighbours
    and then the label of that label, so paths shrink by doubling; rounds are cut with checkpoints until nothing
    changes.  Hot nodes are summed before the shuffle.  Returns ``node, component``; empty for no edges.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        )
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = cut(
            lower.join(jump, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("label")).alias("moved"))
        )
        if not moved.where("moved").limit(1).count():
            return moved.select("node", "component")
        labels = moved.select("node", F.col("component").alias("label"))
