"""Ancestors over tables of (child, parent) rows: version histories, feature graphs, bills of material.

Paths double in each round, so a history of a million versions takes twenty rounds. A row may have several parents; rows
with a null end and repeated rows change nothing. A cycle is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, dropped, staged

#: Ancestors of one node that travel in one row.
LIST = 1024


def _edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node IS NOT NULL AND ancestor IS NOT NULL").distinct()
    return e.withColumn("depth", F.lit(1).cast("long"))


def _listed(paths: DataFrame) -> DataFrame:
    """(node, far, depth) with each path's least depth; far and depth are lists of at most LIST ancestors of a node. paths
    has one row per path and is dealt by node already, so that nothing is shuffled here."""
    least = paths.groupBy("node", "ancestor").agg(F.min("depth").cast("int").alias("depth")).sortWithinPartitions("node")

    def run(batches):
        for batch in batches:
            node = batch.column(0)
            new = np.append(True, pa.compute.not_equal(node.slice(1), node.slice(0, len(node) - 1)).to_numpy(zero_copy_only=False)) if len(node) else np.empty(0, bool)
            first = np.flatnonzero(new)
            since = np.arange(len(node)) - np.repeat(first, np.diff(first, append=len(node)))
            first = np.flatnonzero(since % LIST == 0)
            offsets = pa.array(np.append(first, len(node)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(first)), *lists], names=["node", "far", "depth"])

    node, far = (least.schema[c].dataType.simpleString() for c in ("node", "ancestor"))
    return least.mapInArrow(run, f"node {node}, far array<{far}>, depth array<int>")


def _flat(lists: DataFrame) -> DataFrame:
    each = lists.select("node", "depth", F.posexplode("far").alias("i", "ancestor"))
    return each.select("node", "ancestor", F.col("depth")[F.col("i")].cast("long").alias("depth"))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth): everything that a node depends on, with its least distance.

    After a round all paths up to a length are known. The next one lengthens those of just that length by all others: a
    least path of up to twice the length has such a part, so nothing is lost and few paths are met twice. Paths travel as
    lists, and each round's table is deleted once the next one is written.
    """
    lists, reach = staged(_listed(_edges(edges, child, parent).repartition("node")), "paths"), 1
    while True:
        if lists.filter(F.array_contains("far", F.col("node"))).limit(1).count():
            raise ValueError("the edges have a cycle")
        ends = lists.filter(F.array_contains("depth", F.lit(reach)))
        if not ends.limit(1).count():
            return _flat(lists)
        ends = _flat(ends).filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("middle"))
        rest = lists.select(F.col("node").alias("middle"), "far", F.transform("depth", lambda d: d + F.lit(reach)).alias("depth"))
        longer = ends.join(rest, "middle").select("node", "far", "depth")
        before, lists = lists, staged(_listed(_flat(lists.unionByName(longer).repartition("node"))), "paths")
        dropped(before)
        reach *= 2


def roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth) for children of one parent each: the first of a node's history and how far away it is."""
    up = _edges(edges, child, parent)
    if up.groupBy("node").count().filter("count > 1").limit(1).count():
        raise ValueError("a node has several parents")
    up = checkpointed(up)
    n, rounds = up.count(), 0
    while True:
        on = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        new = checkpointed(up.join(on, "ancestor", "left").select("node", F.coalesce("next", "ancestor").alias("ancestor"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        rounds += 1
        if not new.filter("moved").limit(1).count():
            return new.select("node", F.col("ancestor").alias("root"), "depth")
        if 1 << rounds > 2 * n + 2:
            raise ValueError("the edges have a cycle")
        up = new.drop("moved")
