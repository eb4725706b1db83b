"""Cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import arrays
from loomspark.operators import graph, joins, metrics, pooling, sampling, signal, validate, vectors, windows
from loomspark.plans.features import Feature, FeatureStore
from loomspark.plans.model import apply_model, validated_windows


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_tumbling_count(events):
    e = events([("a", i, i) for i in range(10)])
    w = windows.tumbling_count(e, 3, ["key"], "ts", "event_id", [F.sum("value").alias("s")])
    assert column(w, "s", "window_id") == [3, 12, 21]
    w = windows.tumbling_count(e, 3, ["key"], "ts", "event_id", [F.sum("value").alias("s")], include_partial=True)
    assert column(w, "s", "window_id") == [3, 12, 21, 9]
    assert windows.tumbling_count(e.limit(0), 3, ["key"], "ts", "event_id", [F.sum("value").alias("s")]).count() == 0
    with pytest.raises(ValueError):
        windows.tumbling_count(e, 0, ["key"], "ts", "event_id", [])


def test_anchored_windows(events):
    e = events([("a", t, 1) for t in (0, 20, 50, 60, 90, 100, 130)])
    w = windows.tumbling_anchored(e, 50_000, "key", "ts", "event_id", "value")
    assert column(w, "n", "window_id") == [3, 3]
    w = windows.tumbling_anchored(e, 50_000, "key", "ts", "event_id", "value", include_partial=True)
    assert column(w, "n", "window_id") == [3, 3, 1]


@pytest.mark.parametrize("block", [4, 100])
def test_sliding_count(events, block):
    e = events([("a", i, i) for i in range(8)])
    w = windows.sliding_count(e, 4, ["key"], "ts", "event_id", F.avg("value"), 2, block=block)
    assert column(w, "agg", "idx") == [0.5, 1, 1.5, 2.5, 3.5, 4.5, 5.5]
    w = windows.sliding_count(e, 4, ["key"], "ts", "event_id", F.avg("value"), 2, mode="every_slide", block=block)
    assert column(w, "agg", "idx") == [0.5, 1.5, 3.5, 5.5]


def test_throttled_and_sessions(events):
    e = events([("a", t, v) for v, t in enumerate((0, 10, 30, 40, 70), 1)])
    f = windows.sliding_time(e, 50_000, ["key"], "ts", {"s": F.sum("value")}, block_us=50_000)
    assert column(windows.throttled(f.select("key", "event_id", "us", "s"), 30_000, "key", "us", "event_id"), "s", "us") == [1, 6, 12]
    s = windows.sessions(events([("a", t, 1) for t in (0, 10, 20, 170, 180)]), "100 milliseconds", ["key"], "ts", [])
    assert column(s, "n", "session_start") == [3, 2]
    s = windows.sessions(events([("a", t, 1) for t in (0, 100)]), "100 milliseconds", ["key"], "ts", [])
    assert column(s, "n", "session_start") == [2]
    day = windows.tumbling_time(events([("a", i, i) for i in range(10)]), "1 day", ["key"], "ts", [F.percentile("value", 0.9).alias("p")])
    assert day.first().p == pytest.approx(8.1)


def test_joins(events):
    left = events([("a", 50, 0)])
    right = events([("a", 0, 0), ("a", 100, 10), (None, 50, 99)])
    args = (["key"], "ts", "event_id", "value")
    for how, want in (("linear", 5), ("nearest", 0), ("zero", 0), ("none", None)):
        assert joins.left_nearest(left, right, *args, 20_000, how).first().right_value == want
    assert joins.left_nearest(left, right, *args, 200_000).first().right_value == 0
    assert joins.nearest_within(left, right, *args, 100_000).first().right_value == 0
    assert joins.nearest_within(left, right, *args, 20_000).count() == 0
    past = events([("a", 1070, 1), ("a", 1080, 2), ("a", 1090, 3)])
    now = events([("a", 1100, 0)])
    for tolerance, want in ((50_000, [3]), (10_000, [3]), (5_000, []), (None, [3])):
        assert [r.right_value for r in joins.asof_backward(now, past, *args, tolerance).collect()] == want
    lost = joins.asof_backward(events([(None, 60, 0)]), right, *args, None, inner=False)
    assert lost.first().right_value is None
    s = events([("a", 0, 1), ("a", 10, 0)]).withColumn("stream", F.when(F.col("event_id") == 0, "s1").otherwise("s2"))
    got = joins.last_known(s, ["s1", "s2"], ["key"], "ts", "event_id", "value").orderBy("event_id").collect()
    assert [(r.s1, r.s2) for r in got] == [(1, None), (1, 0)]


def test_validation(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0]), (float("nan"), [3.0, float("inf")])], "x double, v array<double>")
    errors = lambda rules, strict=False: validate.validate(df, rules, strict).first().errors
    assert errors([validate.in_range("x", 0, 2), validate.in_range("v", 0, None)]) == []
    assert errors([validate.not_nan("x"), validate.not_inf("v")]) == ["v: contains Inf", "x: contains NaN"]
    assert errors([validate.shape("v", [2, 3])]) == ["v: Dimension 1: expected 3, got 2"]
    assert errors([validate.shape("v", ["*", 2]), validate.dtype("x", "double")]) == []
    assert "Unexpected field: x" in errors([validate.required("v")], strict=True)
    rules = [validate.in_range("x", 0, 2), validate.custom("x", "x < 5", "too big")]
    assert validate.load_schema(validate.save_schema(rules, True)) == (rules, True)
    assert validate.validate(df.limit(0), rules).first().ok


def test_drift(spark):
    rows = [(b, 0.5 + 0.1 * math.cos(3 * i + b)) for b in range(20) for i in range(50)] + [(20, 5.0 + 0.1 * math.cos(i)) for i in range(50)]
    d = validate.drift(spark.createDataFrame(rows, "b long, v double"), "b", "v").orderBy("b").collect()
    assert [r.mean_shift for r in d] == [False] * 20 + [True] and d[20].range_shift


def test_sampling(spark):
    labels = spark.range(100).select("id", (F.col("id") >= 70).cast("int").alias("label"))
    counts = lambda df: sorted((r.label, r["count"]) for r in df.groupBy("label").count().collect())
    assert counts(sampling.stratified(labels, 20, "label", "id")) == [(0, 14), (1, 6)]
    three = spark.range(100).select("id", F.when(F.col("id") < 50, 0).when(F.col("id") < 80, 1).otherwise(2).alias("label"))
    assert counts(sampling.balanced(three, 15, "label", "id")) == [(0, 5), (1, 5), (2, 5)]
    assert counts(sampling.balanced(three, 16, "label", "id")) == [(0, 6), (1, 5), (2, 5)]
    assert sampling.sample_uniform(labels, 500, "id").count() == 100
    assert sampling.with_replacement(labels, 250, "id").count() == 250
    b = sampling.batches(labels, 32, "id").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [32, 32, 32, 4]
    assert sampling.batches(labels, 32, "id", drop_last=True).count() == 96
    n = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(1).alias("label"))
    for how, want in (("inverse", (0.2, 1.8)), ("inverse_sqrt", (0.5, 1.5)), ("effective", (0.2764, 1.7236))):
        assert column(sampling.class_weights(n, "label", how), "weight", "label") == pytest.approx(want, abs=1e-4)
    losses = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0)], "id long, t long, loss double")
    scores = sampling.difficulty(losses, "id", ["t"], "loss")
    assert scores.first().difficulty == pytest.approx(1.29)
    assert sampling.adaptive(labels, 10, "id", "label", scores, epoch=9).count() == 10
    assert sampling.focal(labels, 10, "id", "label", scores).count() == 10
    ratios = sampling.sampling_stats(labels, sampling.stratified(labels, 20, "label", "id"), "label")
    assert column(ratios, "ratio", "label") == [1.0, 1.0]


def test_vectors(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    k = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 3.0])], "key_id string, vector array<double>")
    got = lambda m, n=3: [(r.key_id, round(r.score, 6)) for r in vectors.knn(q, k, n, m).orderBy("rank").collect()]
    assert got("cosine") == [("a", 1.0), ("b", 0.707107), ("c", 0.0)]
    assert got("dot") == [("a", 2.0), ("b", 1.0), ("c", 0.0)]
    assert got("l2", 9) == [("a", -1.0), ("b", -1.0), ("c", -10.0)]
    assert vectors.knn(q, k.limit(0), 2).count() == 0 and vectors.knn(q.limit(0), k, 2).count() == 0
    log = lambda rows: spark.createDataFrame([("b", s, i, a) for i, (a, s) in enumerate(rows)], "bank string, slot long, t long, kind string")
    fifo = vectors.retain(log([("write", i) for i in range(1, 6)]), 3, "bank", "slot", ["t"])
    assert sorted(r.slot for r in fifo.collect()) == [3, 4, 5]
    lru = vectors.retain(log([("write", 1), ("write", 2), ("write", 3), ("read", 1), ("write", 4)]), 3, "bank", "slot", ["t"])
    assert sorted(r.slot for r in lru.collect()) == [1, 3, 4]
    lfu = vectors.retain_lfu(log([("write", 1), ("write", 2), ("write", 3), ("read", 1), ("read", 1), ("read", 3), ("write", 4), ("write", 5)]), 3, "bank", "slot", "t", "kind")
    assert sorted(r.slot for r in lfu.collect()) == [1, 3, 5]


def test_graph_and_pooling(spark):
    nodes = spark.createDataFrame([(i, float(10 + i)) for i in range(4)], "id long, x double")
    edges = spark.createDataFrame([(0, 1, 1.0, 0.0), (1, 2, 1.0, 0.0), (2, 0, 1.0, 0.0)], "dst long, src long, weight double, score double")
    assert column(graph.neighbor_aggregate(nodes, edges, ["x"]), "x", "id") == [11, 12, 10, 0]
    assert column(graph.neighbor_aggregate(nodes, edges, ["x"], hops=4, weight="weight"), "x", "id") == [11, 12, 10, 0]
    two = spark.createDataFrame([(0, 1, 0.5), (0, 3, 0.5)], "dst long, src long, score double")
    assert column(graph.edge_softmax(nodes, two, ["x"]), "x", "id") == [12, 0, 0, 0]
    p = pooling.pair_summary(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0)], "g long, x double"), "g", "x").orderBy("x").collect()
    assert [(r.mean_diff, r.mean_product) for r in p] == [(-2, 3), (-1, 6), (3, 18)]
    none = pooling.masked_pool(spark.createDataFrame([(1, [1.0])], "g long, v array<double>"), "g", "v", F.lit(False), "max")
    assert none.first().value == -1e9


def test_signal_and_metrics(spark):
    n = spark.createDataFrame([("s", i, math.log(p)) for i, p in enumerate((0.5, 0.3, 0.15, 0.05))], "s string, i long, l double")
    assert sorted(r.i for r in signal.nucleus(n, "s", "i", "l", top_p=0.75).collect()) == [0, 1]
    assert signal.nucleus(n, "s", "i", "l", temperature=0).first().i == 0
    x = spark.createDataFrame([("s", i, float(i + 1)) for i in range(4)], "s string, i long, x double")
    assert column(signal.causal_filter(x, [1, 10], "x", ["s"], ["i"], 2), "filtered", "i") == [1, 2, 13, 24]
    h = spark.createDataFrame([("s", i, 0.5) for i in (1, 2, 3)], "s string, n long, h double")
    pmf = signal.stopping_pmf(h, "s", ["n"], "h")
    assert column(pmf, "pmf", "n") == [0.5, 0.25, 0.25]
    assert signal.geometric_kl(pmf, "s").first().mean_steps == 1.75
    assert signal.receptive_field(3, [1, 2, 4]) == 15
    views = spark.createDataFrame([(0, p, v, [1.0, 0.0] if p == 0 else [0.0, 1.0]) for p in (0, 1) for v in (0, 1)], "b long, p long, v long, e array<double>")
    assert metrics.info_nce(views, "b", "p", "v", "e", 1.0).first().loss == pytest.approx(0.551445, abs=1e-6)
    one = spark.createDataFrame([([1.0], [0.0])], "mu array<double>, lv array<double>")
    assert metrics.vae_loss(one, F.col("mu"), F.col("mu"), F.col("mu"), F.col("lv")).first().kl == 0.5
    t = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.1), (float("nan"), float("nan")), (float("inf"), float("inf"))], "a double, b double")
    assert [r[0] for r in t.select(arrays.is_close(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_feature_store(spark, tmp_path):
    store = FeatureStore()
    store.register(Feature("A", lambda df: F.col("x") * 2))
    store.register(Feature("B", lambda df: df["A"] + 1, ["A"]))
    store.register(Feature("C", lambda df: df["A"] * 3, ["A"]))
    store.register(Feature("D", lambda df: df["B"] + df["C"], ["B", "C"]))
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3)], "id long, x double")
    assert column(store.compute(df, ["D"]), "D", "id") == [9, 17, 25]
    assert set(store.dependencies("D")) == {"A", "B", "C"} and store.order(["D"])[0] == "A"
    assert {(r.feature, r.dependency, r.depth) for r in store.lineage(spark).collect()} >= {("D", "A", 2), ("D", "B", 1), ("B", "A", 1)}
    with pytest.raises(ValueError):
        store.register(Feature("A", lambda df: df["D"], ["D"]))
    with pytest.raises(ValueError):
        store.compute(df, ["Z"])
    with pytest.raises(ValueError):
        store.current("A", "9.9")
    store.save(df, ["D"], f"file://{tmp_path}/saved")
    values, conflicts = store.load(spark, f"file://{tmp_path}/saved")
    assert values.count() == 3 and conflicts.count() == 0
    store.register(Feature("D", lambda df: df["B"], ["B"], version="2.0"))
    assert [(r.saved, r.current) for r in store.load(spark, f"file://{tmp_path}/saved")[1].collect()] == [("1.0", "2.0")]
    a = store.materialise(df, ["D"], f"file://{tmp_path}/cache", "id")
    done = store.computed
    assert column(store.materialise(df, ["D"], f"file://{tmp_path}/cache", "id", 3600), "D", "id") == column(a, "D", "id") and store.computed == done
    assert store.versions(spark).count() == 5 and store.statistics(spark).first().features == 4


def test_model_and_composition(spark, events):
    out = apply_model(spark.range(5), lambda: lambda pdf: pdf.assign(y=pdf["id"] * 2.0), "id long, y double")
    assert sorted(r.y for r in out.collect()) == [0, 2, 4, 6, 8]
    e = events([("a", i, i) for i in range(6)] + [("a", 9, -1)])
    w, bad = validated_windows(e, [validate.in_range("value", 0, None)], 3, ["key"], "ts", "event_id", [F.sum("value").alias("s")])
    assert column(w, "s", "window_id") == [3, 12] and bad.count() == 1
