import tempfile

import pytest
from pyspark.sql import functions as F

from loomspark.functions.timeutil import HOUR, micros
from loomspark.operators import joins, windows
from loomspark.sources.tables import observed, read_stream, union_streams
from loomspark.streaming import stateful

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(autouse=True)
def store(spark):
    """Operators on keyed streams choose a state store; the next test starts from the default one."""
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/events"
    e = spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    for day in ("0", "1", "2"):  # files in the order of their events
        e.filter(F.floor((F.dayofmonth("ts") - 1) / 11).cast("string") == day).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name).collect(), q


def stream(spark, folder, **options):
    return read_stream(spark, folder, spark.read.parquet(folder).schema, "ts", "1 hour", **options)


def closed(spark, folder):
    return spark.read.parquet(folder).agg(F.max(micros("ts"))).first()[0] - HOUR


def test_time_windows_equal_batch(spark, folder):
    aggs = [F.count(F.lit(1)).alias("n")]
    got, q = run(spark, stateful.windowed(stream(spark, folder), "tumbling", "ts", ["event_type"], aggs, "1 hour"), "tumbling")
    batch = windows.tumbling_time(spark.read.parquet(folder), "1 hour", ["event_type"], "ts", aggs)
    want = batch.filter(micros("window_start") + HOUR <= closed(spark, folder)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and stateful.late_rows(q) == 0


def test_sessions_equal_batch(spark, folder):
    got, _ = run(spark, stateful.windowed(stream(spark, folder), "session", "ts", ["user_id"], [F.sum("value").alias("v")], "8 hours"), "sessions")
    batch = windows.sessions(spark.read.parquet(folder), "8 hours", ["user_id"], "ts", [F.sum("value").alias("v")])
    want = batch.filter(micros("session_end") + 8 * HOUR <= closed(spark, folder)).collect()
    key = lambda rows: sorted((r.user_id, r.session_start, r.session_end, r.n, round(r.v, 6)) for r in rows)
    assert key(got) == key(want)


def test_count_windows_equal_batch(spark, folder):
    got, _ = run(spark, stateful.tumbling_count(stream(spark, folder, max_files=1), 3, "user_id", "ts", "event_id", "value"), "counts")
    before = spark.read.parquet(folder).filter(micros("ts") < closed(spark, folder))
    want = windows.tumbling_count(before, 3, ["user_id"], "ts", "event_id", [F.sum("value").alias("total")]).collect()
    key = lambda rows: sorted((r.user_id, r.window_id, round(r.total, 6)) for r in rows)
    assert key(got) == key(want)


def test_asof_equals_batch(spark, folder):
    s = stream(spark, folder, max_files=1)
    left, right = s.filter("event_type = 'purchase'"), s.filter("event_type = 'view'")
    got, _ = run(spark, stateful.asof(left, right, "user_id", "ts", "event_id", "value", 24 * HOUR), "asof")
    e = spark.read.parquet(folder)
    batch = joins.asof_backward(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "ts", "event_id", "value", 24 * HOUR, inner=False)
    want = batch.filter(micros("ts") < closed(spark, folder)).collect()
    assert sorted((r.tie, r.right_value) for r in got) == sorted((r.event_id, r.right_value) for r in want)


def test_interval_join(spark, folder):
    s = stream(spark, folder)
    left = s.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = s.filter("event_type = 'click'").select("user_id", F.col("ts").alias("rts"), F.col("value").alias("rv"))
    got, _ = run(spark, stateful.interval_join(left, right, ["user_id"], "ts", "rts", "12 hours"), "intervals")
    e = spark.read.parquet(folder)
    a, b = e.filter("event_type = 'purchase'").alias("a"), e.filter("event_type = 'click'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOURS AND a.ts + INTERVAL 12 HOURS")).count()
    assert len(got) == want


def brute_left(lefts, rights, window, fallback, reach):
    out = {}
    for k, t, i, _ in lefts:
        own = sorted((u, j, v) for kk, u, j, v in rights if kk == k and abs(u - t) <= reach)
        p, q = [r for r in own if r[0] <= t][-1:], [r for r in own if r[0] > t][:1]
        near = min(p + q, key=lambda r: abs(r[0] - t), default=None)
        if near and abs(near[0] - t) <= window:
            out[i] = near[2]
        elif fallback == "linear" and p and q:
            a = (t - p[0][0]) / (q[0][0] - p[0][0])
            out[i] = (1 - a) * p[0][2] + a * q[0][2]
        else:
            out[i] = {"zero": 0.0, "nearest": near[2] if near else None}.get(fallback)
    return out


@pytest.mark.parametrize("fallback", ["none", "nearest", "linear", "zero"])
def test_left_join_with_fallback(spark, folder, fallback):
    s, reach = stream(spark, folder, max_files=1), 96 * HOUR
    joined = stateful.join_statistics(stateful.nearest_left(s.filter("event_type = 'purchase'"), s.filter("event_type = 'view'"), "user_id", "ts", "event_id", "value", HOUR, fallback, reach), f"seen_{fallback}")
    got, q = run(spark, joined, f"left_{fallback}")
    e = [(r.user_id, r.us, r.event_id, r.value, r.event_type) for r in spark.read.parquet(folder).withColumn("us", micros("ts")).collect()]
    want = brute_left([r[:4] for r in e if r[4] == "purchase" and r[1] + reach < closed(spark, folder)], [r[:4] for r in e if r[4] == "view"], HOUR, fallback, reach)
    near = lambda x: None if x is None else round(x, 6)
    assert {r.tie: near(r.right_value) for r in got} == {i: near(x) for i, x in want.items()} and want
    seen = [p["observedMetrics"][f"seen_{fallback}"] for p in q.recentProgress if p["observedMetrics"]]
    assert sum(m["rows"] for m in seen) == len(got) == sum(m[k] for m in seen for k in ("joins", "misses", "interpolations", "fallbacks"))


def test_nearest_join_equals_batch(spark, folder):
    s = stream(spark, folder)
    left = s.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = s.filter("event_type = 'click'").select("user_id", F.col("ts").alias("rts"), F.col("value").alias("rv"))
    got, _ = run(spark, stateful.nearest_join(left, right, ["user_id"], "ts", "rts", "event_id", "12 hours", "rv"), "nearest")
    e = spark.read.parquet(folder)
    batch = joins.nearest_within(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), ["user_id"], "ts", "event_id", "value", 12 * HOUR)
    want = {r.event_id: round(r.right_value, 6) for r in batch.collect()}
    assert got and all(round(r.rv, 6) == want[r.event_id] for r in got)


def test_last_known_equals_batch(spark, folder):
    s = stream(spark, folder, max_files=1).withColumnRenamed("event_type", "stream")
    got, _ = run(spark, stateful.last_known(s, ["view", "click"], "user_id", "ts", "event_id", "value", retention_us=100 * HOUR), "known")
    e = spark.read.parquet(folder).withColumnRenamed("event_type", "stream")
    batch = joins.last_known(e, ["view", "click"], ["user_id"], "ts", "event_id", "value", retention_us=100 * HOUR).filter(micros("ts") < closed(spark, folder)).collect()
    assert sorted((r.tie, str(r.view), str(r.click)) for r in got) == sorted((r.event_id, str(r.view), str(r.click)) for r in batch)


def test_throttled_equals_batch(spark, folder):
    got, _ = run(spark, stateful.throttled(stream(spark, folder, max_files=1), "event_type", "ts", "event_id", "value", 12 * HOUR, 6 * HOUR), "throttled")
    e = windows.sliding_time(spark.read.parquet(folder), 12 * HOUR, ["event_type"], "ts", {"total": F.sum("value")})
    want = windows.throttled(e.filter(micros("ts") < closed(spark, folder)), 6 * HOUR, "event_type", "us", "event_id").collect()
    assert sorted((r.tie, round(r.total, 4)) for r in got) == sorted((r.event_id, round(r.total, 4)) for r in want)


def test_rows_over_the_cap_are_shed(spark, folder):
    day = 24 * HOUR
    got, _ = run(spark, stateful.shed_rows(stream(spark, folder, max_files=1), 5, "ts", "event_id", "value", day), "shed_rows")
    e = [(r.us // day, r.us, r.event_id) for r in spark.read.parquet(folder).withColumn("us", micros("ts")).collect()]
    want = {}
    for w, us, i in sorted(e):
        if (w + 1) * day <= closed(spark, folder) // 1000 * 1000:
            want.setdefault(w, []).append(i)
    assert sorted((r.window, r.tie, r.n_dropped) for r in got) == sorted((w, i, max(0, len(x) - 5)) for w, x in want.items() for i in x[:5]) and want


def test_state_is_capped(spark, folder):
    s = stream(spark, folder, max_files=1)
    got, _ = run(spark, stateful.nearest_left(s.filter("event_type = 'purchase'"), s.filter("event_type = 'view'"), "user_id", "ts", "event_id", "value", HOUR, "nearest", 96 * HOUR, cap=1), "capped")
    assert got and all(r.how in ("joined", "fallback", "missed") for r in got)


def test_shed_union_and_observe(spark, folder):
    got, _ = run(spark, stateful.shed(stream(spark, folder), 1, "ts", "1 hour"), "shed")
    assert got and all(r.n == r.n_kept + r.n_dropped for r in got)
    e = spark.read.parquet(folder)
    both, seen = observed(union_streams({"a": e, "b": e}), "seen", large=F.col("value") > 100)
    both.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 2 * e.count() and seen.get["large"] == 2 * e.filter("value > 100").count()
