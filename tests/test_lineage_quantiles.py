import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import lineage, quantiles, signal


def test_closure_and_roots(spark):
    rng = random.Random(1)
    edges = [(i, rng.randrange(i)) for i in range(1, 80) for _ in range(rng.randint(0, 2))] + [(None, 1), (2, None), (5, 4), (5, 4)]
    got = {(r.node, r.ancestor): r.depth for r in lineage.closure(spark.createDataFrame(edges, "c long, p long"), "c", "p").collect()}
    parents = {}
    for c, p in edges:
        if c is not None and p is not None:
            parents.setdefault(c, set()).add(p)
    want = {}
    for n in parents:
        level, d = parents[n], 1
        while level:
            for a in level:
                want.setdefault((n, a), d)
            level, d = {b for a in level for b in parents.get(a, ()) if (n, b) not in want}, d + 1
    assert got == want
    chain = spark.range(1, 500).selectExpr("id AS c", "id - 1 AS p")
    assert {(r.node, r.root, r.depth) for r in lineage.roots(chain, "c", "p").collect()} == {(i, 0, i) for i in range(1, 500)}
    assert lineage.roots(chain.limit(0), "c", "p").collect() == [] == lineage.closure(chain.limit(0), "c", "p").collect()


def test_closure_keeps_one_table_and_bounded_lists(spark):
    """Earlier rounds leave nothing in the shared folder, and a node with many ancestors is several rows there."""
    edges = [(5000, i) for i in range(1, 3000)] + [(i, i - 1) for i in range(1, 20)] + [(6000, 5000)]
    lineage.closure(spark.createDataFrame([(2, 1)], "c long, p long"), "c", "p").collect()
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: {os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.startswith("part-")}
    before = size()
    out = lineage.closure(spark.createDataFrame(edges, "c long, p long"), "c", "p")
    left = {os.path.dirname(f) for f in size() - before}
    assert len(left) == 1
    assert spark.read.parquet(*left).selectExpr("max(size(far)) AS n").collect()[0].n <= lineage.LIST
    got = {(r.node, r.ancestor): r.depth for r in out.collect()}
    want = {(5000, i): 1 for i in range(1, 3000)} | {(5000, 0): 2, (6000, 5000): 1, (6000, 0): 3} | {(6000, i): 2 for i in range(1, 3000)}
    want |= {(i, j): i - j for i in range(1, 20) for j in range(i)}
    assert got == want


@pytest.mark.parametrize("f", [lineage.closure, lineage.roots])
def test_a_cycle_is_an_error(spark, f):
    with pytest.raises(ValueError, match="cycle"):
        f(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "c long, p long"), "c", "p")


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000), "b": np.array([5.0]), "same": np.full(50, 2.5), "two": np.array([1.0, 1e12]), "far": np.append(rng.normal(size=999), 1e15), None: rng.integers(0, 4, 77).astype(float)}
    rows = [(k, float(v), 1) for k, vs in groups.items() for v in vs] + [("a", None, 1), ("none", None, 1)]
    got = {r.k: r.quantile for r in quantiles.exact_quantile(spark.createDataFrame(rows, "k string, n double, low int"), ["k"], "n", q).collect()}
    assert got.pop("none") is None
    assert got == pytest.approx({k: np.quantile(v, q) for k, v in groups.items()})
    whole = [v for vs in groups.values() for v in vs]
    assert quantiles.exact_quantile(spark.createDataFrame(rows, "k string, n double, low int"), [], "n", q).first().quantile == pytest.approx(np.quantile(whole, q))


def test_causal_stack_in_blocks(spark):
    """Several dilations, blocks shorter than the halo, and a caller's columns."""
    x = np.random.default_rng(6).normal(size=300)
    layers = [([1.0, -0.5, 0.25], 1), ([0.5, 2.0], 3), ([1.0, 1.0], 9)]
    want = x
    for weights, d in layers:
        want = sum(w * np.concatenate([np.zeros(j * d), want[: len(want) - j * d]]) for j, w in enumerate(weights))
    df = spark.createDataFrame([("s", i, float(v), -1, -2) for i, v in enumerate(x)], "s string, i long, x double, _x int, _place int")
    for block in (1, 20, 100_000):
        got = signal.causal_stack(df, layers, "x", ["s"], ["i"], bucket=F.floor(F.col("i") / 37), block=block).orderBy("i").collect()
        assert [r.filtered for r in got] == pytest.approx(want.tolist()) and all(r._x == -1 and r._place == -2 for r in got)
    assert signal.receptive_field(3, [1]) + signal.receptive_field(2, [3, 9]) - 1 == 15
