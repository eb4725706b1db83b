"""Windows over event streams held as tables: by count, by time, sliding and by session."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from ..functions.ordered import in_order, other, walk
from ..functions.timeutil import DAY, micros, ordered_index, time_bucket


def tumbling_count(df: DataFrame, size: int, keys: Sequence[str], ts: str, tie: str, aggs: Sequence[Column], include_partial: bool = False) -> DataFrame:
    """Groups of `size` rows in (ts, tie) order per key: keys, window_id, n, aggs. The open rest only if asked for."""
    if size < 1:
        raise ValueError("size must be positive")
    idx = unused(df, "_idx")
    numbered = ordered_index(df, keys, [ts, tie], time_bucket(micros(ts), DAY), idx)
    out = numbered.groupBy(*keys, F.floor(F.col(idx) / size).alias("window_id")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return out if include_partial else out.filter(F.col("n") == size)


def tumbling_time(df: DataFrame, size: str, keys: Sequence[str], ts: str, aggs: Sequence[Column]) -> DataFrame:
    """Epoch-aligned windows: window_start, keys, aggs. Works on streams with a watermark."""
    return df.groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggs).withColumn("window_start", F.col("w.start")).drop("w")


def tumbling_anchored(df: DataFrame, size_us: int, key: str, ts: str, tie: str, value: str, include_partial: bool = False) -> DataFrame:
    """Windows anchored at a key's first event; the event that reaches the size closes the window, belongs to it, and
    its time anchors the next. Columns: key, window_id, n, first_us, last_us, sum. Order dependence per key is real, so
    each key is one sequential pass in Arrow batches that keeps the open window's anchor, count and sum."""
    kind = df.schema[key].dataType.simpleString()

    class Open:
        def __init__(self):
            self.anchor, self.id = None, 0
            self.clear()

        def clear(self):
            self.n, self.first, self.last, self.sum = 0, None, None, 0.0

        def end(self):
            return [(self.id, self.n, self.first, self.last, self.sum)] if include_partial and self.n else []

        def step(self, us, v):
            if self.anchor is None:
                self.anchor = us
            if not self.n:
                self.first = us
            self.n, self.last = self.n + 1, us
            self.sum = None if v is None or self.sum is None else self.sum + v
            if us is None or us - self.anchor < size_us:
                return ()
            closed = (self.id, self.n, self.first, self.last, self.sum)
            self.anchor, self.id = us, self.id + 1
            self.clear()
            return (closed,)

    slim = df.select(F.col(key).alias("k"), micros(ts).alias("us"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("v"))
    dealt = in_order(slim, "k", [F.col("us").asc_nulls_last(), F.col("tie").asc_nulls_last()]).select("k", "us", "v")
    names, kinds = [key, "window_id", "n", "first_us", "last_us", "sum"], [pa.int64()] * 4 + [pa.float64()]
    return dealt.mapInArrow(walk(Open, names, kinds), f"`{key}` {kind}, window_id long, n long, first_us long, last_us long, sum double")


def sliding_count(df: DataFrame, size: int, keys: Sequence[str], ts: str, tie: str, agg: Column, slide: int | None = None, mode: str = "min_rows", block: int = 100_000) -> DataFrame:
    """The last `size` rows at each row, agg over them as `agg`. slide defaults to size.

    min_rows: a row once the frame has `slide` rows. every_slide: each slide-th row. Rows are dealt in blocks of
    positions, each with the size - 1 rows before it, so that a hot key spreads. Columns idx and agg are added; if df has
    them, they are called idx_ and agg_.
    """
    slide = size if slide is None else slide
    if slide < 1 or size < 1:
        raise ValueError("size and slide must be positive")
    block = max(block, size)
    name, held, own = (unused(df, c) for c in ("idx", "_block", "_own"))
    idx = F.col(name)
    numbered = ordered_index(df, keys, [ts, tie], time_bucket(micros(ts), DAY), name).withColumn(held, F.floor(idx / block))
    halo = numbered.filter(idx % block > block - size).withColumn(held, F.col(held) + 1)
    both = numbered.withColumn(own, F.lit(True)).unionByName(halo.withColumn(own, F.lit(False)))
    frame = Window.partitionBy(*keys, held).orderBy(name).rowsBetween(-(size - 1), 0)
    ready = F.least(idx + 1, F.lit(size)) >= slide if mode == "min_rows" else (idx + 1) % slide == 0
    return both.withColumn(unused(df, "agg"), agg.over(frame)).filter(own).filter(ready).drop(held, own)


def sliding_time(df: DataFrame, size_us: int, keys: Sequence[str], ts: str, aggs: dict[str, Column], block_us: int = DAY) -> DataFrame:
    """At each row, aggregates over the rows of its key in [t - size, t], peers included. Blocks of time with a halo."""
    block_us = max(block_us, size_us)
    b = df.withColumn("us", micros(ts)).withColumn("_block", time_bucket(F.col("us"), block_us))
    halo = b.filter(F.col("us") >= (F.col("_block") + 1) * block_us - size_us).withColumn("_block", F.col("_block") + 1)
    both = b.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    frame = Window.partitionBy(*keys, "_block").orderBy("us").rangeBetween(-size_us, 0)
    return both.withColumns({n: a.over(frame) for n, a in aggs.items()}).filter("_own").drop("_block", "_own")


def throttled(df: DataFrame, slide_us: int, key: str, us: str, tie: str) -> DataFrame:
    """Of each key's rows the first, then each that is at least slide_us after the last one kept. One pass per key in
    Arrow batches that keeps the last time."""
    at = [df.columns.index(c) for c in (key, us)]

    def run(batches):
        now, last, begun = None, None, False
        for batch in batches:
            keep = []
            for k, t in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                first = not begun or other(k, now)
                keep.append(first or t is not None and last is not None and t - last >= slide_us)
                if keep[-1]:
                    now, last, begun = k, t, True
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_order(df, key, [F.col(us).asc_nulls_last(), F.col(tie).asc_nulls_last()]).mapInArrow(run, df.schema)


def sliding_hop(df: DataFrame, size: str, slide: str, keys: Sequence[str], ts: str, aggs: Sequence[Column]) -> DataFrame:
    """Epoch-aligned hopping windows: window_start, keys, aggs. Works on streams with a watermark."""
    return df.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*aggs).withColumn("window_start", F.col("w.start")).drop("w")


def sessions(df: DataFrame, gap: str, keys: Sequence[str], ts: str, aggs: Sequence[Column]) -> DataFrame:
    """Sessions that a gap longer than `gap` ends: keys, session_start, session_end, n, aggs.

    Start and end are the first and last event; only they may be filtered on, never the session window itself. The
    event after the gap starts the next session.
    """
    s = df.groupBy(F.session_window(ts, gap).alias("w"), *keys)
    out = s.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n"), *aggs)
    return out.drop("w")


def array_window(df: DataFrame, keys: Sequence[str], array: str, how: str = "mean") -> DataFrame:
    """Element-wise mean, sum, max or min of arrays per key: keys, pos, value."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    return df.select(*keys, F.posexplode(F.col(array).cast("array<double>")).alias("pos", "x")).groupBy(*keys, "pos").agg(agg("x").alias("value"))


def shed(df: DataFrame, cap: int, ts: str, tie: str, window: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(kept, counts): the first `cap` rows of each window in (ts, tie) order; n, n_kept and n_dropped per window.

    Rows are ranked within minutes first, and only those that can still be kept within the window. kept has columns
    window_start and rank; if df has them, they are called window_start_ and rank_.
    """
    start, minute, place, rank = (unused(df, c) for c in ("window_start", "_minute", "_place", "rank"))
    w = df.withColumn(start, F.window(ts, window)["start"]).withColumn(minute, F.date_trunc("minute", ts))
    first = w.withColumn(place, F.row_number().over(Window.partitionBy(start, minute).orderBy(ts, tie))).filter(F.col(place) <= cap)
    kept = first.withColumn(rank, F.row_number().over(Window.partitionBy(start).orderBy(ts, tie))).filter(F.col(rank) <= cap).drop(place, minute)
    counts = w.groupBy(F.col(start).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return kept, counts.select("window_start", "n", F.least("n", F.lit(cap)).cast("long").alias("n_kept"), F.greatest(F.col("n") - cap, F.lit(0)).cast("long").alias("n_dropped"))
