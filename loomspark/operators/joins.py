"""Temporal joins of keyed event streams held as tables.

Rows with a null key match nothing. Driving rows are never lost by a left join and never doubled. Times are compared in
microseconds. Ties: the earlier event, then the smaller tie-break value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.carry import carried
from ..functions.timeutil import HOUR, micros, time_bucket


def _side(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column | str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, micros(ts).alias("us"), F.col(tie).alias("tie"), v.alias("value"))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, tolerance_us: int | None = None, inner: bool = True, out: str = "right_value", bucket_us: int | None = None) -> DataFrame:
    """left with the most recent right value at or before it, at most tolerance_us old (both ends inclusive).

    Both sides are unioned and the last right row carried forward. With a tolerance, keys are cut into time buckets no
    narrower than it, and right rows also sent to the next bucket; without one, the last values of buckets are carried
    over a table of buckets. Either way a hot key spreads. A row without a time has no value.
    """
    keys = list(keys)
    named = [f"_k{i}" for i in range(len(keys))]
    u = _aligned(left, right, keys, ts, tie, F.col(value))
    if tolerance_us is None:
        u = carried(u, named, "_us", ["_side", "_tie"], ["_hit"], bucket_us=bucket_us or HOUR)
        ok = F.col("_hit").isNotNull()
    else:
        own = time_bucket(F.col("_us"), max(bucket_us or 0, tolerance_us, 1))
        u = u.withColumn("_b", F.explode(F.when(F.col("_side") == 1, F.array(own)).otherwise(F.array(own, own + 1))))
        w = Window.partitionBy(*named, "_b").orderBy("_us", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
        ok = F.col("_us") - F.col("_hit.us") <= tolerance_us
    found = u.filter("_side = 1").select("_row.*", F.when(ok, F.col("_hit.value")).alias(out), F.when(ok, F.col("_hit.us")).alias(out + "_us"))
    return found.filter(F.col(out + "_us").isNotNull()) if inner else found


def _aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column) -> DataFrame:
    """Both sides as rows (keys as _k0, ..., _us, _side, _tie, _row of left, _hit of right): no name of a caller's clashes.
    Rows of right without a key or time are left out."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*(F.col(c) for c in left.columns))
    hit = F.struct(micros(ts).alias("us"), value.alias("value"))
    b = right.filter(_present(keys)).select(*named, micros(ts).alias("_us"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), hit.alias("_hit")).filter("_us IS NOT NULL")
    a = left.select(*named, micros(ts).alias("_us"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), row.alias("_row"))
    return a.unionByName(b, allowMissingColumns=True)


def _present(keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys), F.lit(True))


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, window_us: int, out: str = "right_value", inner: bool = True) -> DataFrame:
    """left with its nearest right value of abs time difference <= window_us. A banded equi-join: right rows go to the
    time bucket before, at and after their own, and are matched by key and bucket. The nearest is found once per key and
    time of left, then joined to left's rows, so that equal rows all stay."""
    keys = list(keys)
    width = max(window_us, 1)
    r = _side(right, keys, ts, tie, value)
    r = r.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct("us", "tie", "value").alias("_r"), F.explode(F.array(*(time_bucket(F.col("us"), width) + d for d in (-1, 0, 1)))).alias("_rb"))
    l = left.withColumn("_lus", micros(ts))  # noqa: E741
    asked = l.select("_lus", *keys).distinct().withColumn("_lb", time_bucket(F.col("_lus"), width))
    on = reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_{k}") for k in keys), F.col("_lb") == F.col("_rb"))
    near = F.abs(F.col("_r.us") - F.col("_lus"))
    best = asked.join(r, on & (near <= window_us)).groupBy(F.col("_lus").alias("_gus"), *(F.col(k).alias(f"_g{k}") for k in keys)).agg(F.min(F.struct(near.alias("gap"), F.col("_r"))).alias("_hit"))
    same = reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_g{k}") for k in keys), F.col("_lus") == F.col("_gus"))
    return l.join(best, same, "inner" if inner else "left").select(*left.columns, F.col("_hit._r.value").alias(out), F.col("_hit._r.us").alias(out + "_us"))


def nearest_many(left: DataFrame, rights: dict[str, DataFrame], keys: Sequence[str], ts: str, tie: str, value: str, window_us: int) -> DataFrame:
    """left with the nearest value of every named right stream; only rows that all of them match."""
    return reduce(lambda acc, item: nearest_within(acc, item[1], keys, ts, tie, value, window_us, item[0]).drop(item[0] + "_us"), rights.items(), left)


def left_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, window_us: int, fallback: str = "none", out: str = "right_value") -> DataFrame:
    """Every left row with the nearest right value within window_us, else by `fallback`: none, nearest, linear or zero.

    The last right row is carried backward and the next one forward, over time buckets of a key. linear: (1 - a) * before
    + a * after with a = (t - t1) / (t2 - t1); before has ts <= t, after ts > t; a missing side gives null. A row without
    a key or time has no nearest value, and zero gives 0.
    """
    if fallback not in ("none", "nearest", "linear", "zero"):
        raise ValueError(f"unknown fallback {fallback}")
    keys = list(keys)
    u = _aligned(left, right, keys, ts, tie, F.col(value).cast("double")).withColumn("_ahead", F.col("_hit"))
    u = carried(u, [f"_k{i}" for i in range(len(keys))], "_us", ["_side", "_tie"], ["_hit"], ["_ahead"]).filter("_side = 1")
    u = u.select("_row", *(f"_k{i}" for i in range(len(keys))), F.col("_us").alias("us"), F.col("_hit").alias("p"), F.col("_ahead").alias("q"))
    dp, dq = F.col("us") - F.col("p.us"), F.col("q.us") - F.col("us")
    near = F.when(F.col("q.us").isNull() | (dp <= dq), F.col("p.value")).otherwise(F.col("q.value"))
    gap = F.least(dp, dq)
    alpha = dp / (F.col("q.us") - F.col("p.us"))
    other = {"none": F.lit(None).cast("double"), "zero": F.lit(0.0), "nearest": near, "linear": (1 - alpha) * F.col("p.value") + alpha * F.col("q.value")}[fallback]
    ok = _present([f"_k{i}" for i in range(len(keys))]) & F.col("us").isNotNull()
    value_out = F.when(~ok, F.lit(0.0) if fallback == "zero" else F.lit(None)).when(gap <= window_us, near).otherwise(other)
    return u.select("_row.*", value_out.alias(out))


def last_known(streams: DataFrame, names: Sequence[str], keys: Sequence[str], ts: str, tie: str, value: str, stream: str = "stream", retention_us: int | None = None) -> DataFrame:
    """On every arrival the latest value of each named stream of its key, null before its first or past the retention.
    A row without a key or time knows its own value alone. Names replace columns of streams that are called so."""
    keys, names = list(keys), list(names)
    hits = [F.when(F.col(stream) == n, F.struct(micros(ts).alias("us"), F.col(value).alias("value"))).alias(f"_h{i}") for i, n in enumerate(names)]
    row = F.struct(*(F.col(c) for c in streams.columns)).alias("_row")
    s = streams.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), micros(ts).alias("_us"), F.col(tie).alias("_tie"), F.col(stream).alias("_stream"), row, *hits)
    s = carried(s, [f"_k{i}" for i in range(len(keys))], "_us", ["_tie"], [f"_h{i}" for i in range(len(names))])
    out = {}
    for i, n in enumerate(names):
        hit = F.col(f"_h{i}")
        known = _present([f"_k{j}" for j in range(len(keys))]) | (F.col("_stream") == n)
        if retention_us is not None:
            known = known & (F.col("_us") - hit["us"] <= retention_us)
        out[n] = F.when(known, hit["value"])
    return s.select(*(F.col("_row")[c].alias(c) for c in streams.columns if c not in out), *(c.alias(n) for n, c in out.items()))


def asof_many(left: DataFrame, rights: dict[str, DataFrame], keys: Sequence[str], ts: str, tie: str, value: str, tolerance_us: int | None = None) -> DataFrame:
    """left with the latest value of every named right stream; only rows that all of them match."""
    return reduce(lambda acc, item: asof_backward(acc, item[1], keys, ts, tie, value, tolerance_us, True, item[0]), rights.items(), left)


def within_retention(df: DataFrame, stream: str, ts: str, window_us: int, cap: int | None = 1000, tie: str | None = None) -> DataFrame:
    """Rows no older than twice the window before their stream's newest, at most the newest `cap` per stream; of rows of
    one time those with the larger `tie`, or, without one, the larger hash of the row."""
    us = micros(ts)
    newest = df.groupBy(F.col(stream).alias("_s")).agg(F.max(us).alias("_newest"))
    out = df.join(newest, df[stream] == newest["_s"]).filter(us >= F.col("_newest") - 2 * window_us).drop("_s", "_newest")
    if cap is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(stream).orderBy(us.desc(), F.col(tie).desc() if tie else F.xxhash64(*df.columns).desc()))).filter(F.col("_r") <= cap).drop("_r")


def point_in_time(labels: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, ttl_us: int | None = None, out: str = "feature") -> DataFrame:
    """Each label row with the feature value known at its time: the newest at or before it, no older than ttl_us."""
    return asof_backward(labels, history, keys, ts, tie, value, ttl_us, False, out)


def combine(left: DataFrame, right: DataFrame, key: str, a: str, b: str, how: str = "average", out: str = "fused") -> DataFrame:
    """Equi-join of two keyed vectors: average or product element by element, or concat."""
    how_col = {"average": lambda: F.zip_with(F.col("_a"), F.col("_b"), lambda x, y: (x + y) / 2), "product": lambda: F.zip_with(F.col("_a"), F.col("_b"), lambda x, y: x * y), "concat": lambda: F.concat("_a", "_b")}[how]()
    l, r = left.select(key, F.col(a).cast("array<double>").alias("_a")), right.select(key, F.col(b).cast("array<double>").alias("_b"))  # noqa: E741
    return l.join(r, key).select(key, how_col.alias(out))
