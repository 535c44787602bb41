"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge table of longs.

    Each round takes the least label among a node's neighbours and then that label's own label, so paths
    shorten by doubling. Labels are written to the shared folder each round; only a change flag reaches
    the driver. An empty edge table has no nodes. Edges with a null end are ignored."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = staged(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(pairs.select("a", F.col("a").alias("b"))).union(pairs.select(F.col("b").alias("a"), "b")).distinct())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("a").alias("near"), F.col("label").alias("far"))
        after = staged(near.join(jump, "near").join(labels, "a").select("a", F.least("far", "near").alias("label"), (F.least("far", "near") < F.col("label")).alias("moved")))
        labels = after.select("a", "label")
        if after.where("moved").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
