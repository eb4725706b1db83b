"""Keyed streams give what the batch operators give for events that the watermark has passed, with bounded state."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.functions.timeutil import HOUR, micros
from loomspark.operators import joins, windows
from loomspark.streaming import keyed
from test_streaming import closed, folder, run, stream  # noqa: F401


def settled(spark, folder):  # noqa: F811
    return spark.read.parquet(folder).filter(micros("ts") < closed(spark, folder))


def rounded(x):
    return None if x is None else round(x, 5)


@pytest.mark.parametrize("mode,slide,how", [("min_rows", 2, "mean"), ("every_slide", 2, "max")])
def test_sliding_count(spark, folder, mode, slide, how):  # noqa: F811
    got, _ = run(spark, keyed.sliding_count(stream(spark, folder, max_files=1), 4, "user_id", "ts", "event_id", "value", how, slide, mode), f"sliding_{how}")
    agg = {"mean": F.avg, "max": F.max}[how]("value")
    want = windows.sliding_count(settled(spark, folder), 4, ["user_id"], "ts", "event_id", agg, slide, mode).collect()
    assert sorted((r.tie, rounded(r.agg)) for r in got) == sorted((r.event_id, rounded(r.agg)) for r in want) and want


def test_anchored(spark, folder):  # noqa: F811
    got, _ = run(spark, keyed.tumbling_anchored(stream(spark, folder, max_files=1), 6 * HOUR, "user_id", "ts", "event_id", "value"), "anchored")
    want = windows.tumbling_anchored(settled(spark, folder), 6 * HOUR, "user_id", "ts", "event_id", "value").collect()
    key = lambda rows: sorted((r.user_id, r.window_id, r.n, r.first_us, r.last_us, rounded(r.sum)) for r in rows)
    assert key(got) == key(want) and want


def _sides(df):
    return df.filter("event_type = 'purchase'"), {"v": df.filter("event_type = 'view'"), "c": df.filter("event_type = 'click'")}


def test_nearest_of_several_streams(spark, folder):  # noqa: F811
    left, rights = _sides(stream(spark, folder, max_files=1))
    got, _ = run(spark, keyed.nearest_many(left, rights, "user_id", "ts", "event_id", "value", 24 * HOUR), "nearest_many")
    left, rights = _sides(spark.read.parquet(folder))
    batch = joins.nearest_many(left, rights, ["user_id"], "ts", "event_id", "value", 24 * HOUR)
    want = batch.filter(micros("ts") + 24 * HOUR < closed(spark, folder)).collect()
    assert sorted((r.tie, r.v, r.c) for r in got) == sorted((r.event_id, r.v, r.c) for r in want) and want


def test_latest_of_several_streams(spark, folder):  # noqa: F811
    left, rights = _sides(stream(spark, folder, max_files=1))
    got, _ = run(spark, keyed.asof_many(left, rights, "user_id", "ts", "event_id", "value", 48 * HOUR), "asof_many")
    left, rights = _sides(spark.read.parquet(folder))
    want = joins.asof_many(left, rights, ["user_id"], "ts", "event_id", "value", 48 * HOUR).filter(micros("ts") < closed(spark, folder)).collect()
    assert sorted((r.tie, r.v, r.c) for r in got) == sorted((r.event_id, r.v, r.c) for r in want) and want


SCHEMA = "k string, ts timestamp, i long, v double"
T = datetime(2024, 1, 1)


def _files(spark, *batches):
    path = tempfile.mkdtemp(prefix="spark-") + "/in"
    for rows in batches:
        spark.createDataFrame([(k, T + timedelta(hours=h), i, v) for k, h, i, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path).withWatermark("ts", "1 hour")


def _evicted(q, name):
    return sum(p["observedMetrics"][name]["evicted"] for p in q.recentProgress if name in p.get("observedMetrics", {}))


def test_a_silent_key_is_forgotten_and_counted(spark):
    first = [("silent", 0, 1, 1.0), ("silent", 1, 2, 2.0), ("loud", 0, 3, 1.0)]
    later = [[("loud", 10 * n, 10 + n, 1.0)] for n in range(1, 6)]
    s = _files(spark, first, *later, [("silent", 55, 90, 5.0)], [("loud", 80, 91, 1.0)], [("loud", 120, 92, 1.0)])
    bounded = keyed.evictions(keyed.sliding_count(s, 3, "k", "ts", "i", "v", "sum", 1, idle_us=20 * HOUR), "forgotten")
    got, q = run(spark, bounded, "forgotten_rows")
    sums = {r.tie: r.agg for r in got}
    assert sums[1] == 1.0 and sums[2] == 3.0
    assert sums[90] == 5.0  # its earlier events were gone
    assert sums[15] == 3.0  # a key that goes on keeps its ring
    assert _evicted(q, "forgotten") >= 3  # two of the silent key at first, one later
    unbounded, _ = run(spark, keyed.sliding_count(_files(spark, first, *later, [("silent", 55, 90, 5.0)], [("loud", 80, 91, 1.0)], [("loud", 120, 92, 1.0)]), 3, "k", "ts", "i", "v", "sum", 1), "kept_rows")
    assert {r.tie: r.agg for r in unbounded}[90] == 8.0


def test_a_cap_drops_the_oldest_and_counts(spark):
    rows = [("a", 0, i, float(i)) for i in range(10)]
    out = keyed.evictions(keyed.tumbling_count(_files(spark, rows, [("a", 5, 50, 1.0)], [("a", 9, 60, 1.0)]), 4, "k", "ts", "i", "v", cap=6), "dropped")
    got, q = run(spark, out, "capped_rows")
    # The first batch loses the oldest four of ten; one more goes when an event arrives before the watermark has passed.
    assert [r.total for r in sorted(got, key=lambda r: r.window_id)][:1] == [5.0 + 6 + 7 + 8]
    assert _evicted(q, "dropped") == 5
    assert all(s["rows"] > 0 for s in keyed.buffer_status(q)) and keyed.buffer_status(q)


def test_odd_events(spark):
    rows = [("a", 0, None, 1.0), ("a", 0, 2, None), ("a", 1, 3, 4.0), (None, 1, 4, 5.0), (None, 2, 5, 6.0)]
    s = _files(spark, rows, [("z", 50, 9, 0.0)], [("z", 99, 9, 0.0)])
    got, _ = run(spark, keyed.tumbling_count(s, 2, "k", "ts", "i", "v"), "odd_counts")
    assert {(r.k, r.total) for r in got if r.k != "z"} == {("a", 1.0), (None, 11.0)}
