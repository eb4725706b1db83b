"""Event-time operators on unbounded streams. Each gives what the batch operator gives for rows the watermark has passed."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import micros
from ..operators import windows
from .keyed import asof, asof_many, buffer_status, evictions, last_known, nearest_many, sliding_count, throttled, tumbling_anchored, tumbling_count

__all__ = ["asof", "asof_many", "buffer_status", "evictions", "interval_join", "join_statistics", "last_known", "late_rows", "nearest_join", "nearest_left", "nearest_many", "shed", "shed_rows", "sliding_count", "throttled", "tumbling_anchored", "tumbling_count", "windowed"]


def windowed(stream: DataFrame, kind: str, ts: str, keys: Sequence[str], aggs: Sequence[Column], size: str, slide: str | None = None) -> DataFrame:
    """Tumbling, sliding or session windows of a stream with a watermark, by the operators that batch tables use."""
    if kind == "tumbling":
        return windows.tumbling_time(stream, size, keys, ts, aggs)
    if kind == "sliding":
        return windows.sliding_hop(stream, size, slide or size, keys, ts, aggs)
    if kind == "session":
        return windows.sessions(stream, size, keys, ts, aggs)
    raise ValueError(f"unknown window {kind}")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, within: str, how: str = "inner") -> DataFrame:
    """Stream-stream join of rows with equal keys whose times are at most `within` apart. Both sides have watermarks, so
    state is bounded and a left join can give up on a row. Column names must differ but for the keys."""
    r = right.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns))
    near = F.expr(f"{right_ts} BETWEEN {left_ts} - INTERVAL {within} AND {left_ts} + INTERVAL {within}")
    on = near
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(r, on, how).drop(*(f"_{k}" for k in keys))


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, left_id: str, within: str, value: str) -> DataFrame:
    """The nearest right value of each left row; later and earlier events count alike, ties go to the earlier."""
    j = interval_join(left, right, keys, left_ts, right_ts, within)
    gap = F.abs(micros(left_ts) - micros(right_ts))
    return j.groupBy(left_id, left_ts).agg(F.min_by(value, F.struct(gap, F.col(right_ts))).alias(value))


def _stateful(grouped, run, out: str, state: str) -> DataFrame:
    return grouped.applyInPandasWithState(run, out, state, "append", "EventTimeTimeout")


def nearest_left(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, value: str, window_us: int, fallback: str = "none", reach_us: int | None = None, cap: int | None = None) -> DataFrame:
    """(key, tie, us, right_value, how): every left row with the nearest right value within window_us, else by `fallback`:
    none, nearest, linear or zero, as the batch join has it, from right rows at most reach_us (window_us if null) away.

    A left row is given out when the watermark has passed it by reach_us. how: joined, fallback, interpolated or missed.
    Right rows out of reach leave the state; with `cap`, so do the oldest ones beyond that many per key.
    """
    if fallback not in ("none", "nearest", "linear", "zero"):
        raise ValueError(f"unknown fallback {fallback}")
    kind, reach = dict(left.dtypes)[key], max(reach_us or window_us, window_us)
    side = lambda df, s: df.select(key, ts, micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"), F.lit(s).alias("side"))

    def decide(us: int, times: list[int], rights: list[tuple]) -> tuple[float | None, str]:
        at = bisect_right(times, us)
        p = rights[at - 1] if at and us - times[at - 1] <= reach else None
        q = rights[at] if at < len(times) and times[at] - us <= reach else None
        both = [r for r in (p, q) if r]
        near = min(both, key=lambda r: abs(r[0] - us)) if both else None  # p is first, so a tie goes to the earlier
        if near and abs(near[0] - us) <= window_us:
            return near[2], "joined"
        if fallback == "zero":
            return 0.0, "fallback"
        if fallback == "nearest" and near:
            return near[2], "fallback"
        if fallback == "linear" and p and q:
            alpha = (us - p[0]) / (q[0] - p[0])
            return (1 - alpha) * p[2] + alpha * q[2], "interpolated"
        return None, "missed"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lu, li, ru, ri, rv = map(list, state.get) if state.exists else ([], [], [], [], [])
        for pdf in frames:
            a, b = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
            lu += a["us"].tolist()
            li += a["tie"].tolist()
            ru += b["us"].tolist()
            ri += b["tie"].tolist()
            rv += b["value"].tolist()
        done = state.getCurrentWatermarkMs() * 1000
        rights, lefts, out = sorted(zip(ru, ri, rv, strict=True)), sorted(zip(lu, li, strict=True)), []
        times = [r[0] for r in rights]
        for us, i in lefts:
            if us + reach >= done:
                break
            out.append((k[0], i, us, *decide(us, times, rights)))
        wait = lefts[len(out) :]
        oldest = min([done, *(u for u, _ in wait)]) - reach
        keep = [r for r in rights if r[0] >= oldest]
        keep = keep[-cap:] if cap else keep
        if wait or keep:
            state.update(([u for u, _ in wait], [i for _, i in wait], [r[0] for r in keep], [r[1] for r in keep], [r[2] for r in keep]))
            until = (wait[0][0] if wait else keep[-1][0]) + reach
            state.setTimeoutTimestamp(max(int(until // 1000) + 1, int(done // 1000) + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "tie", "us", "right_value", "how"])

    both = side(left, 1).unionByName(side(right, 0))
    return _stateful(both.groupBy(key), run, f"`{key}` {kind}, tie long, us long, right_value double, how string", "lu array<long>, li array<long>, ru array<long>, ri array<long>, rv array<double>")


def shed(stream: DataFrame, cap: int, ts: str, window: str) -> DataFrame:
    """Per window the number of events, of those a cap lets through and of those it drops; for append output."""
    n = windows.tumbling_time(stream, window, [], ts, [F.count(F.lit(1)).alias("n")])
    return n.select("window_start", "n", F.least("n", F.lit(cap)).alias("n_kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("n_dropped"))


def shed_rows(stream: DataFrame, cap: int, ts: str, tie: str, value: str, window_us: int) -> DataFrame:
    """(window, tie, us, value, n_dropped): the first `cap` events of each window, and how many others it has dropped.

    Events beyond the cap are shed on arrival, so the state holds at most `cap` per window; a window is given out when
    the watermark has passed its end.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        us, ids, values, dropped = [list(x) if isinstance(x, (list, tuple)) else x for x in state.get] if state.exists else ([], [], [], 0)
        rows = list(zip(us, ids, values, strict=True))
        for pdf in frames:
            rows = sorted([*rows, *zip(pdf["us"].tolist(), pdf["tie"].tolist(), pdf["value"].tolist(), strict=True)])
            rows, dropped = rows[:cap], dropped + len(rows[cap:])
        end = (int(k[0]) + 1) * window_us
        if end <= state.getCurrentWatermarkMs() * 1000:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(k[0], i, u, v, dropped) for u, i, v in rows], columns=["window", "tie", "us", "value", "n_dropped"])
            return
        state.update(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], dropped))
        state.setTimeoutTimestamp(end // 1000)
        yield pd.DataFrame([], columns=["window", "tie", "us", "value", "n_dropped"])

    slim = stream.select(ts, micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    slim = slim.withColumn("window", F.floor(F.col("us") / window_us).cast("long"))
    return _stateful(slim.groupBy("window"), run, "window long, tie long, us long, value double, n_dropped long", "us array<long>, tie array<long>, value array<double>, dropped long")


def join_statistics(joined: DataFrame, name: str) -> DataFrame:
    """joined (of nearest_left) whose micro-batches also count rows, joins, misses, interpolations and fallbacks: they are
    in the query's progress under `name`."""
    how = lambda kind: F.count(F.when(F.col("how") == kind, 1))
    return joined.observe(name, F.count(F.lit(1)).alias("rows"), how("joined").alias("joins"), how("missed").alias("misses"), how("interpolated").alias("interpolations"), how("fallback").alias("fallbacks"))


def late_rows(query) -> int:
    """Rows that the watermark has dropped in a query so far."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p.get("stateOperators", []))
