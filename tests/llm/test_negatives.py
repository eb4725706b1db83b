import math
import random

import numpy as np
import pytest

from loomspark.llm import negatives
from loomspark.llm.negatives import Best, Block, hard_negatives, rank, summary

SCHEMA = "vec_id long, embedding array<float>, label int, lows string, score int, b string"


def brute(rows, every=50, relabel=True):
    clean = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and vec_id % 7 == 0:
            label = (label + 1) % 10
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        if sum(c * c for c in x) < 2**62:
            clean[vec_id, label, tuple(x)] = None
    out = set()
    for a, la, va in clean:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, vb, strict=True)), b, lb) for b, lb, vb in clean if b != a and len(vb) == len(va))
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fit = [(s, b) for s, b, lb in scored if lb != la and 50 * -ps <= 100 * -s <= 95 * -ps]
            out |= {(a, p, i + 1, b, -ps, -s) for i, (s, b) in enumerate(fit[:3])}
    return out


def vectors(seed, n=400, dim=24, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.6 * scale) for x in c]
        if i and rng.random() < 0.3:
            v = rows[rng.randrange(len(rows))][1]  # equal vectors: ties
        rows.append((i, v, rng.randrange(10), "x", 1, "y"))
    return rows


@pytest.mark.parametrize("scale,dim", [(0.2, 24), (300.0, 7), (2e5, 5), (0.3, 1)])
def test_rows_equal_brute_force(spark, monkeypatch, scale, dim):
    monkeypatch.setattr(negatives, "ANCHOR_CELL", 3 * dim)
    monkeypatch.setattr(negatives, "ROW_CELL", 90 * dim)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    rows = vectors(dim, dim=dim, scale=scale)
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), every=10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, every=10)


def test_odd_rows(spark):
    rows = vectors(3, 120)
    odd = [(None, [1.0] * 24, 1), (500, None, 1), (550, [1.0, None] * 12, 1), (600, [float("nan")] * 24, 1), (650, [float("inf")] * 24, 1), (700, [1.0] * 24, None)]
    odd += [(750, [3e38] * 24, 1), (800, [0.5, 0.25], 1), (801, [0.5, 0.5], 1), (802, [0.5, 0.0], 2), (850, [], 1), (851, [], 1), (852, [], 2)]
    rows = rows + [(*r, "x", 1, "y") for r in odd] + rows[:5]
    table = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in hard_negatives(table).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert any(r[0] == 850 for r in got) and any(r[0] == 800 for r in got)
    assert hard_negatives(table.limit(0)).collect() == []
    assert hard_negatives(table.filter("vec_id % 50 != 0")).collect() == []


@pytest.mark.parametrize("dim", [1, 3, 24, 64])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-300, 300, (40, dim)) for _ in range(2))
    score = a @ b.T
    blocks = [Block(np.arange(40), np.zeros(40, np.int64), v, summary(v.astype(np.float64))) for v in (a, b)]
    last = np.inf
    for (m, d), (mine, off) in zip(*(list(x.levels()) for x in blocks), strict=True):
        middle, reach = m @ mine.T, d @ off.T + 1
        assert (middle - reach <= score).all() and (score <= middle + reach).all()
        assert reach.mean() <= last
        last = reach.mean()


def test_summaries_spare_exact_scores():
    """Of vectors whose segments differ in level, most pairs are dropped by their summaries alone."""
    rng = np.random.default_rng(1)
    centres = np.repeat(rng.normal(0, 100, (40, 16)), 4, axis=1)
    v = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 4, (6000, 64))).astype(np.int64)
    block = Block(np.arange(6000), np.zeros(6000, np.int64), v, summary(v.astype(np.float64)))
    anchors, counts = block.take(np.arange(0, 6000, 100)), np.zeros(2, np.int64)
    low, high = np.full((60, 1), np.iinfo(np.int64).min), np.full((60, 1), np.iinfo(np.int64).max)
    best = Best(low, high, 5)
    rank(anchors, block, best, counts)
    want = []
    for i, x in enumerate(anchors.vectors @ v.T):
        order = [j for j in np.lexsort((np.arange(6000), -x)) if j != anchors.ids[i]][:5]
        want += [(i, x[j], j) for j in order]
    assert list(zip(best.row, best.score, best.id, strict=True)) == want
    assert counts[1] < counts[0] / 4
