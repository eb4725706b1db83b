"""Connected components from DataFrame joins and minimums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Each round takes the least of a node's label, its neighbours' labels and its label's own label, so that chains halve.
    A hub's edges are pre-aggregated before the shuffle, and its label is broadcast to them, so that no task gets them
    all. Edges with a null end are left out; repeated edges and loops change nothing; no edges give an empty result.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = stage(both.union(both.select("b", "a")).distinct(), "edges")
    rows = both.count()
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        near = join_sized(both.select("a", F.col("b").alias("node")), labels, "node", "degree", rows)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # A label's own label, from one row per label: pre-aggregated, and broadcast where it is a hub's.
        shared = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        root = shared.join(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), "label")
        joined = join_sized(labels, root, "label", "members", rows).join(near, "node")
        least = F.least("label", "near", "root")
        before, labels = labels, stage(joined.select("node", least.alias("label"), "degree", (least != F.col("label")).alias("moved")), "labels")
        unstage(before)
        if not labels.filter("moved").limit(1).count():
            unstage(both)
            return labels.select("node", F.col("label").alias("component"))
