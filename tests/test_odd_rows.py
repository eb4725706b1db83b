"""Nulls, repeated rows and clashing names in the core operators."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import metrics, sampling, vectors, windows

T = datetime(2024, 1, 1)
SCHEMA = "id long, label string, ts timestamp_ntz, value double, _v double, _b string, _w int, _d int, _u int, _r int, n int, idx int, row int, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 200 else None, ["a", "b", None][i % 3], T + timedelta(minutes=i), float(i), 1.5, "b", 7, 8, 9, 10, 11, 12, 13, 14) for i in range(1000)]
    return spark.createDataFrame(rows, SCHEMA)


def whole(rows):
    return all((r._v, r._b, r._w, r._d, r._u, r._r, r.n, r.idx, r.row, r.bucket) == (1.5, "b", 7, 8, 9, 10, 11, 12, 13, 14) for r in rows)


def test_rows_without_an_id_are_drawn_like_others(spark, odd):
    got = [sampling.sample_uniform(odd, 100, "id", seed).collect() for seed in range(8)]
    assert all(len(g) == 100 and whole(g) for g in got)
    drawn = [sum(r.id is None for r in g) for g in got]
    assert min(drawn) < 5 and sum(drawn) < 20  # five such rows in a thousand, so about one in two draws of 100


def test_null_is_a_class(odd):
    rows = sampling.balanced(odd, 30, "label", "id").collect()
    assert Counter(r.label for r in rows) == {"a": 10, "b": 10, None: 10} and whole(rows)
    rows = sampling.stratified(odd, 30, "label", "id").collect()  # classes of 334, 333 and 333 rows
    assert Counter(r.label for r in rows) == {"a": 10, "b": 9, None: 9} and whole(rows)


def test_quotas_are_exact_for_hot_and_rare_classes(spark):
    df = spark.range(30_000).selectExpr("id", "CASE WHEN id < 5 THEN 'rare' WHEN id % 100 = 0 THEN 'some' ELSE 'hot' END AS label")
    got = Counter(r.label for r in sampling.balanced(df, 900, "label", "id").collect())
    assert got == {"rare": 5, "some": 299, "hot": 300} or got == {"rare": 5, "some": 300, "hot": 300}
    every = sorted((int.from_bytes(__import__("hashlib").md5(f"0:{i}".encode()).digest()[:6]), i) for i in range(5, 30_000) if i % 100)[:300]
    assert {r.id for r in sampling.balanced(df, 900, "label", "id").filter("label = 'hot'").collect()} == {i for _, i in every}


def test_weighted_focal_and_adaptive(spark, odd):
    scores = spark.createDataFrame([(1, 0.5, 2.0), (1, 4.0, 3.0), (2, 1.0, None), (None, 9.0, 9.0)], "id long, difficulty double, last_loss double")
    for got in (
        sampling.weighted(odd, 50, F.col("value"), "id"),
        sampling.focal(odd, 1000, "id", "label", scores),
        sampling.focal(odd, 1000, "id", "label", None),
        sampling.adaptive(odd, 1000, "id", "label", scores, 9),
    ):
        rows = got.collect()
        assert len(rows) in (50, 1000) and whole(rows) and max(Counter(r.value for r in rows).values()) == 1


def test_draws_with_replacement(spark, odd):
    df = odd.filter("value > 0")
    draws = sampling.with_replacement(df, 20_000, "id", weight=F.col("value"))
    rows = draws.collect()
    assert sorted(r.draw for r in rows) == list(range(20_000)) and whole(rows)
    high = sum(r.value >= 500 for r in rows) / 20_000
    assert abs(high - sum(range(500, 1000)) / sum(range(1000))) < 0.02
    plan = draws._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sampling.with_replacement(df.limit(0), 5, "id").collect() == []


def test_windows_keep_the_callers_columns(odd):
    df = odd.withColumns({"rank": F.lit("mine"), "window_start": F.lit("mine"), "_idx": F.lit(3), "agg": F.lit(5)})
    counts = windows.tumbling_count(df, 10, ["label"], "ts", "value", [F.max("_b").alias("b"), F.max("idx").alias("i"), F.max("_idx").alias("x")]).collect()
    assert counts and all((r.b, r.i, r.x) == ("b", 12, 3) for r in counts)
    slid = windows.sliding_count(df, 3, ["label"], "ts", "value", F.sum("value")).collect()
    assert slid and whole(slid) and all(r.agg == 5 and r.agg_ > 0 for r in slid)
    kept, _ = windows.shed(df, 5, "ts", "value")
    rows = kept.collect()
    assert rows and whole(rows) and all(r["rank"] == "mine" and r.window_start == "mine" and 1 <= r.rank_ <= 5 for r in rows)


def test_knn_graph_without_some_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [("g" if i % 9 else None, i, None if i % 7 == 0 else rng.normal(size=3).tolist()) for i in range(60)]
    got = vectors.knn_graph(spark.createDataFrame(rows, "g string, n long, v array<double>"), 4, "g", "n", "v").collect()
    held = [(i, np.array(v)) for g, i, v in rows if g and v]
    want = {(i, j) for i, v in held for j in [j for _, j in sorted((round(float(((v - w) ** 2).sum()), 9), j) for j, w in held)][:4]}
    assert {(r.src, r.dst) for r in got} == want


def test_cells_spare_comparisons():
    """On clusters the answer is that of all pairs, from far fewer."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 20 + rng.normal(size=(4000, 8)) * 0.1
    x[100:140] = x[7]  # ties
    counts = np.zeros(2, np.int64)
    row, col, d = vectors.nearest_rows(x[:1000], x, 5, counts)
    exact = np.round(np.maximum((x[:1000] ** 2).sum(1)[:, None] - 2 * x[:1000] @ x.T + (x * x).sum(1)[None], 0), 9)
    order = np.argsort(row, kind="stable")
    assert (d[order].reshape(1000, 5) == np.sort(exact, axis=1)[:, :5]).all()
    assert len(np.unique(row * 4000 + col)) == 5000
    assert counts[1] < counts[0] / 5


def test_queue_loss_counts_pairs_with_vectors(spark):
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 0.1]), (None, [1.0, 0.0]), ([0.0, 2.0], None)], "q array<float>, k array<float>")
    queue = spark.createDataFrame([([0.0, 1.0],), (None,)], "v array<float>")
    r = metrics.queue_loss(pairs, queue, "q", "k", "v", 0.5).first()
    pos = 1 / np.hypot(1, 0.1) / 0.5
    assert r.n == 1 and abs(r.loss - (np.log(np.exp(pos) + 1) - pos)) < 1e-6
    none = metrics.queue_loss(pairs, queue.limit(0), "q", "k", "v", 0.5).first()
    assert none.n == 1 and abs(none.loss) < 1e-9
