"""Passes in order over keys that many Arrow batches hold."""

import random

import pytest

from loomspark.operators import sampling, vectors, windows


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def in_batches(df):
    """df's plan hands no whole group to one Python frame."""
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    return df


def data(n=400):
    rng, t = random.Random(5), 0
    return [(rng.choice("aaaab") if i % 9 else None, t := t + rng.randrange(20), rng.randrange(100)) for i in range(n)]


def by_key(rows):
    out = {}
    for i, (k, t, v) in enumerate(rows):
        out.setdefault(k, []).append((t * 1000, i, float(v)))
    return out


def test_anchored(events, small_batches):
    want = []
    for k, rows in by_key(data()).items():
        held, n = [], 0
        anchor = rows[0][0]
        for us, _, v in rows:
            held.append((us, v))
            if us - anchor >= 50_000:
                want.append((k, n, len(held), held[0][0], us, sum(x for _, x in held)))
                anchor, held, n = us, [], n + 1
        if held:
            want.append((k, n, len(held), held[0][0], held[-1][0], sum(x for _, x in held)))
    got = in_batches(windows.tumbling_anchored(events(data()), 50_000, "key", "ts", "event_id", "value", include_partial=True))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_throttled(events, small_batches):
    want = []
    for rows in by_key(data()).values():
        last = None
        for us, i, _ in rows:
            if last is None or us - last >= 30_000:
                want.append(i)
                last = us
    e = events(data()).selectExpr("event_id", "key", "unix_micros(ts) AS us", "value")
    got = in_batches(windows.throttled(e, 30_000, "key", "us", "event_id"))
    assert sorted(r.event_id for r in got.collect()) == sorted(want) and got.columns == e.columns


def test_lfu(spark, small_batches):
    rng = random.Random(6)
    log = [(rng.choice("aaab"), rng.randrange(30), i, rng.choice(["read", "write"])) for i in range(600)]
    want = set()
    for bank in "ab":
        held = {}
        for b, s, _, action in log:
            if b == bank and action == "read" and s in held:
                held[s] += 1
            elif b == bank and action == "write" and s not in held:
                if len(held) >= 5:
                    del held[min(held, key=held.get)]
                held[s] = 0
        want |= {(bank, s, n) for s, n in held.items()}
    got = in_batches(vectors.retain_lfu(spark.createDataFrame(log, "bank string, slot long, t long, kind string"), 5, "bank", "slot", "t", "kind"))
    assert {tuple(r) for r in got.collect()} == want


def test_difficulty_of_a_hot_id(spark, small_batches):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.random() * 9) for i in range(500)] + [(8, 1, 1.0), (8, 2, None), (8, 3, 2.0), (9, 1, 4.0)]
    want = {}
    for k, _, x in rows:
        d = want[k][0] if k in want else x
        want[k] = (None if d is None or x is None else d if k not in want else 0.9 * d + 0.1 * x, x)
    rng.shuffle(rows)
    got = sampling.difficulty(spark.createDataFrame(rows, "id long, t long, loss double").repartition(5), "id", ["t"], "loss")
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower()  # a hot id is not one task's
    assert {r.id: (r.difficulty, r.last_loss) for r in got.collect()} == {k: (d if d is None else pytest.approx(d), x) for k, (d, x) in want.items()}
