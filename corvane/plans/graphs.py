"""Connected components by falling labels, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b).  A label is also replaced by its own label, which halves chains."""
    both = stored(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("src", "node"), "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        after = stored(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("component"), "old"))
        labels = after.select("node", "component")
        if after.filter("component != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
