"""Connected components of an edge table, distributed.

Every node keeps the smallest label it has heard of; rounds of neighbour minima alternate with pointer
jumping. Links and labels stay in Spark: only a count of changes reaches the driver. A hub with very
many links is no group in one task: minima are pre-aggregated before each shuffle, and the joins may be
split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: bigint) -> (node, root): root is the smallest node reachable; nodes without an edge are absent.

    Null ends are ignored; repeated edges and loops do no harm; no edges give an empty table."""
    edges = edges.where("a is not null and b is not null and a <> b")
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "adjacency")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("heard"))
        met = labels.join(heard, "node", "left").select("node", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        # Also a node's old root hears of the new one, and each node takes its root's root.
        hooked = met.where("root < before").groupBy(F.col("before").alias("node")).agg(F.min("root").alias("hook"))
        met = written(met.join(hooked, "node", "left").select("node", "before", F.least("root", "hook").alias("root")), "labels")
        jump = met.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = written(met.join(jump, "root", "left").select("node", "before", F.least("root", "up").alias("root")), "labels")
        done = after.where("root < before").isEmpty()
        discard(labels, met)
        labels = written(after.select("node", "root"), "labels") if done else after.drop("before")
        labels.scratch_path = getattr(labels, "scratch_path", after.scratch_path)
        if done:
            discard(after, both)
            return labels
