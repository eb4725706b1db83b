"""kNN over several blocks of queries."""

import numpy as np
import pytest

from loomspark.operators import vectors


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_knn_in_blocks(spark, metric):
    x = np.random.default_rng(2).normal(size=(120, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, vector array<double>")
    got = vectors.knn(v.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "key_id"), 4, metric, block=7)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = {"cosine": unit @ unit.T, "dot": x @ x.T, "l2": -((x[:, None] - x[None]) ** 2).sum(2)}[metric]
    want = {(q, int(k), r) for q in range(0, 120, 3) for r, k in enumerate(np.lexsort((np.arange(120), -s[q].round(12)))[:4], 1)}
    assert {(r.query_id, r.key_id, r["rank"]) for r in got.collect()} == want
