import random
import time
from datetime import datetime, timedelta

import pytest

from loomspark.functions.timeutil import HOUR
from loomspark.operators import joins, sampling

T = datetime(2024, 1, 1)


def at(*rows):
    return [(k, T + timedelta(microseconds=us), i, v) for k, us, i, v in rows]


SCHEMA = "k string, ts timestamp_ntz, i long, v double"


def test_nearest_keeps_equal_rows_and_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame(at(("a", 100, 1, 0.0), ("a", 100, 1, 0.0), ("a", 100, 2, 9.0), ("a", 900, 3, 0.0), (None, 100, 4, 0.0)), SCHEMA)
    right = spark.createDataFrame(at(("a", 90, 7, 1.0), ("a", 110, 8, 2.0), ("a", 90, 6, 3.0), (None, 100, 9, 4.0)), SCHEMA)
    rows = joins.nearest_within(left, right, ["k"], "ts", "i", "v", 10).collect()
    assert sorted((r.i, r.v, r.right_value) for r in rows) == [(1, 0.0, 3.0), (1, 0.0, 3.0), (2, 9.0, 3.0)]
    kept = joins.nearest_within(left, right, ["k"], "ts", "i", "v", 10, inner=False).collect()
    assert sorted((r.i, str(r.right_value)) for r in kept) == [(1, "3.0"), (1, "3.0"), (2, "3.0"), (3, "None"), (4, "None")]
    many = joins.nearest_many(left, {"x": right, "y": right.filter("i = 8")}, ["k"], "ts", "i", "v", 10).collect()
    assert sorted((r.i, r.x, r.y) for r in many) == [(1, 3.0, 2.0), (1, 3.0, 2.0), (2, 3.0, 2.0)]


def test_retention_cap_breaks_ties(spark):
    df = spark.createDataFrame(at(*(("a", 5, i, 0.0) for i in range(20))), SCHEMA)
    assert sorted(r.i for r in joins.within_retention(df, "k", "ts", 100, 3, "i").collect()) == [17, 18, 19]
    assert joins.within_retention(df, "k", "ts", 100, 3).count() == 3


def test_smallest_equals_sort(spark):
    df = spark.range(5000).withColumn("v", sampling.uniform("s", "id") ** 3)
    every = [r.id for r in df.orderBy("v", "id").collect()]
    for size in (0, 1, 17, 2500, 5000, 9000):
        assert {r.id for r in sampling.smallest(df, size, df.v, "id").collect()} == set(every[:size])
    same = spark.range(50).selectExpr("id", "1.0D AS v")
    assert {r.id for r in sampling.smallest(same, 7, same.v, "id").collect()} == set(range(7))


def _plain_left(lefts, rights, window, fallback):
    out = {}
    for k, us, i, _ in lefts:
        own = sorted((u, j, v) for kk, u, j, v in rights if k is not None and kk == k)
        p, q = [r for r in own if r[0] <= us][-1:], [r for r in own if r[0] > us][:1]
        near = min(p + q, key=lambda r: abs(r[0] - us), default=None)
        if near and abs(near[0] - us) <= window:
            out[i] = near[2]
        elif fallback == "linear":
            out[i] = (1 - (a := (us - p[0][0]) / (q[0][0] - p[0][0]))) * p[0][2] + a * q[0][2] if p and q else None
        else:
            out[i] = {"zero": 0.0, "nearest": near[2] if near else None}.get(fallback)
    return out


@pytest.mark.parametrize("fallback", ["none", "nearest", "linear", "zero"])
def test_carry_over_buckets_equals_brute_force(spark, fallback):
    """Times from microseconds to days apart, so that values are carried within, over and past empty buckets."""
    rng = random.Random(fallback)
    spread = [rng.choice([1, 50, HOUR // 2, HOUR, 30 * HOUR]) * rng.randint(0, 5) for _ in range(400)]
    rows = [(rng.choice(["a", "a", "b", None]), us, i, float(rng.randint(0, 99))) for i, us in enumerate(spread)]
    lefts, rights = rows[:250], rows[250:] + [("a", 50, 990, 1.0), ("a", 50, 991, 2.0)]
    left = spark.createDataFrame(at(*lefts), SCHEMA).selectExpr("k", "ts", "i", "v", "'x' AS us", "1 AS _us", "i AS _bucket", "'p' AS hit")
    got = joins.left_nearest(left, spark.createDataFrame(at(*rights), SCHEMA), ["k"], "ts", "i", "v", 50, fallback).collect()
    want = _plain_left(lefts, rights, 50, fallback)
    near = lambda x: None if x is None else round(x, 6)
    assert {r.i: near(r.right_value) for r in got} == {i: near(v) for i, v in want.items()} and len(got) == len(lefts)
    assert all(r.us == "x" and r._us == 1 and r._bucket == r.i and r.hit == "p" for r in got)


def test_asof_without_tolerance_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, HOUR, 40 * HOUR]) * rng.randint(0, 4), i, float(i)) for i in range(200)]
    lefts, rights = rows[:120], rows[120:]
    got = joins.asof_backward(spark.createDataFrame(at(*lefts), SCHEMA), spark.createDataFrame(at(*rights), SCHEMA), ["k"], "ts", "i", "v", inner=False).collect()
    want = {i: max(((u, j, v) for kk, u, j, v in rights if k is not None and kk == k and u <= us), default=(0, 0, None))[2] for k, us, i, _ in lefts}
    assert {r.i: r.right_value for r in got} == want and len(got) == len(lefts)


def test_rows_without_a_time(spark):
    left = spark.createDataFrame([("a", None, 1, 0.0), ("a", T, 2, 0.0)], SCHEMA)
    right = spark.createDataFrame([("a", T, 3, 5.0), ("a", None, 4, 6.0)], SCHEMA)
    assert {r.i: r.right_value for r in joins.left_nearest(left, right, ["k"], "ts", "i", "v", 10, "nearest").collect()} == {1: None, 2: 5.0}
    assert {r.i: r.right_value for r in joins.asof_backward(left, right, ["k"], "ts", "i", "v", inner=False).collect()} == {1: None, 2: 5.0}


def test_last_known_keeps_the_callers_columns(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.choice([1, HOUR, 40 * HOUR]) * rng.randint(0, 4), i, float(i)) for i in range(150)]
    of = ["x", "y", "z"]
    df = spark.createDataFrame([(*r, of[r[2] % 3], "mine", -1) for r in at(*rows)], SCHEMA + ", stream string, us string, _h0 int")
    for retention in (None, 2 * HOUR):
        got = joins.last_known(df, ["x", "y"], ["k"], "ts", "i", "v", retention_us=retention).collect()
        for r in got:
            k, us, i, _ = rows[r.i]
            for n in ("x", "y"):
                last = max(((u, j, v) for kk, u, j, v in rows if kk == k and (u, j) <= (us, i) and of[j % 3] == n), default=None)
                assert r[n] == (last[2] if last and (retention is None or us - last[0] <= retention) else None)
            assert r.us == "mine" and r._h0 == -1


def test_one_hot_key_takes_seconds(spark):
    """One key of 200,000 rows: no frame grows with the rows that follow, so the time is linear."""
    df = spark.range(200_000).selectExpr("'hot' AS k", "timestamp_micros(id * 7000000) AS ts", "id AS i", "cast(id AS double) AS v")
    left, right = df.filter("i % 2 = 0"), df.filter("i % 5 = 1")
    start = time.monotonic()
    n, total = joins.left_nearest(left, right, ["k"], "ts", "i", "v", 1, "nearest").selectExpr("count(right_value)", "sum(right_value - i)").first()
    assert n == 100_000 and abs(total) < 200_000
    assert joins.asof_backward(left, right, ["k"], "ts", "i", "v").count() == 99_999
    assert time.monotonic() - start < 60
