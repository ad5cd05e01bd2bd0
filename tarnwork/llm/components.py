"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of a stored edge table (a, b): the smallest node that links reach.

    Each round takes the least label among the neighbours (partly aggregated before the
    shuffle, so a node with very many links is no hot spot) and then the label's own label,
    which doubles the reach.  Every round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("node"), "component")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        after = labels.join(near, F.col("node") == F.col("a"), "left").join(jump, F.col("component") == F.col("via"), "left")
        low = F.least("component", F.coalesce("near", "component"), F.coalesce("beyond", "component"))
        after = stored(after.select("node", low.alias("component"), F.col("component").alias("old")), "component-labels")
        labels = after.select("node", "component")
        if after.where(F.col("component") != F.col("old")).isEmpty():
            return labels
