"""Stateful operators on keyed streams over one layer of bounded state.

Events wait in a list state until the watermark has passed them and are then settled in event order, so that each operator
gives what its batch counterpart gives for those events. What an operator remembers of settled events is a list state or
a value state. Both lists can be capped, and a key that stays silent can be forgotten; what is lost so is counted.

Events without a time are left out; a value that is NaN counts as null.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.timeutil import micros

EVENT = "us long, tie long, value double, source string"
US, TIE, VALUE, SOURCE = range(4)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(x):
    return None if x is None or x != x else x


def _total(values) -> float | None:
    """As SQL sums: nulls do not count."""
    held = [v for v in values if v is not None]
    return float(sum(held)) if held else None


def _in_order(events: list[tuple], first: str | None = None) -> list[tuple]:
    """By time, at one time those that are not of source `first`'s before it, then by tie, nulls last."""
    return sorted(events, key=lambda e: (e[US], first is not None and e[SOURCE] == first, e[TIE] is None, e[TIE] or 0))


class Plan:
    """What an operator does with events: see settle. Fields of `memory` are one value state; `lead_us` is how far the
    watermark must be past an event."""

    memory, columns, lead_us = "none long", "", 0

    def settle(self, waiting: list[tuple], kept: list[tuple], memory: tuple | None, done: int) -> tuple[list[tuple], list[tuple], list[tuple], tuple | None]:
        """(rows, waiting, kept, memory) after all that `done` allows; waiting is in event order."""
        raise NotImplementedError


@dataclass
class TumblingCount(Plan):
    size: int
    memory, columns = "window long", "window_id long, n long, total double"

    def settle(self, waiting, kept, memory, done):
        at = bisect_left(waiting, done, key=lambda e: e[US])
        kept, window, out = kept + waiting[:at], memory[0] if memory else 0, []
        while len(kept) >= self.size:
            out.append((window, self.size, _total(e[VALUE] for e in kept[: self.size])))
            kept, window = kept[self.size :], window + 1
        return out, waiting[at:], kept, (window,)


@dataclass
class SlidingCount(Plan):
    size: int
    slide: int
    mode: str
    how: str
    memory, columns = "seen long", "tie long, us long, agg double"

    def settle(self, waiting, kept, memory, done):
        at = bisect_left(waiting, done, key=lambda e: e[US])
        seen, out = memory[0] if memory else 0, []
        for e in waiting[:at]:
            kept, seen = [*kept[-(self.size - 1) :], e] if self.size > 1 else [e], seen + 1
            if len(kept) >= self.slide if self.mode == "min_rows" else seen % self.slide == 0:
                held = [x[VALUE] for x in kept if x[VALUE] is not None]
                of = {"sum": _total, "mean": lambda v: sum(v) / len(v), "max": max, "min": min, "count": len}[self.how]
                out.append((e[TIE], e[US], float(of(held)) if held or self.how == "count" else None))
        return out, waiting[at:], kept, (seen,)


@dataclass
class Anchored(Plan):
    size_us: int
    memory = "anchor long, window long, n long, first long, total double, nulls long"
    columns = "window_id long, n long, first_us long, last_us long, sum double"

    def settle(self, waiting, kept, memory, done):
        at = bisect_left(waiting, done, key=lambda e: e[US])
        anchor, window, n, first, total, nulls = memory or (None, 0, 0, None, 0.0, 0)
        out = []
        for us, _, value, _ in waiting[:at]:
            anchor = us if anchor is None else anchor
            first = us if not n else first
            n, total, nulls = n + 1, total + (value or 0.0), nulls + (value is None)
            if us - anchor >= self.size_us:
                out.append((window, n, first, us, None if nulls else total))
                anchor, window, n, first, total, nulls = us, window + 1, 0, None, 0.0, 0
        return out, waiting[at:], [], (anchor, window, n, first, total, nulls)


@dataclass
class Throttled(Plan):
    size_us: int
    slide_us: int
    memory, columns = "last long", "tie long, us long, total double"

    def settle(self, waiting, kept, memory, done):
        at = bisect_left(waiting, done, key=lambda e: e[US])
        last, out, i = memory[0] if memory else None, [], 0
        while i < at:
            us = waiting[i][US]
            peers = waiting[i : bisect_right(waiting, us, key=lambda e: e[US])]
            kept = [e for e in kept if e[US] >= us - self.size_us] + peers
            for e in peers:
                if last is None or us - last >= self.slide_us:
                    out.append((e[TIE], us, _total(x[VALUE] for x in kept)))
                    last = us
            i += len(peers)
        return out, waiting[at:], kept, (last,)


@dataclass
class Latest(Plan):
    """On each event of `driver` (null: on every event) the last value of every named stream; if inner, only where all of
    them have one."""

    names: list[str]
    driver: str | None
    within_us: int | None
    inner: bool
    memory = "at array<long>, held array<double>"

    @property
    def columns(self):
        return "tie long, us long" + "".join(f", `{n}` double" for n in self.names)

    def settle(self, waiting, kept, memory, done):
        waiting = _in_order(waiting, self.driver)
        until = bisect_left(waiting, done, key=lambda e: e[US])
        at, held = map(list, memory) if memory else ([None] * len(self.names), [None] * len(self.names))
        out = []
        for us, tie, value, source in waiting[:until]:
            if source in self.names:
                at[self.names.index(source)], held[self.names.index(source)] = us, value
            if self.driver is None or source == self.driver:
                fresh = [a is not None and (self.within_us is None or us - a <= self.within_us) for a in at]
                if not self.inner or all(fresh):
                    out.append((tie, us, *(v if ok else None for v, ok in zip(held, fresh, strict=True))))
        return out, waiting[until:], [], (at, held)


@dataclass
class Nearest(Plan):
    """On each event of `driver` the value of every named stream nearest to it and at most within_us away; only where all
    of them have one. An event waits until the watermark is past all that can be near it."""

    names: list[str]
    driver: str
    within_us: int

    @property
    def columns(self):
        return "tie long, us long" + "".join(f", `{n}` double" for n in self.names)

    @property
    def lead_us(self):
        return self.within_us

    def settle(self, waiting, kept, memory, done):
        streams = {n: [e for e in _in_order(kept + [x for x in waiting if x[SOURCE] != self.driver]) if e[SOURCE] == n] for n in self.names}
        times = {n: [e[US] for e in s] for n, s in streams.items()}
        out, wait = [], []
        for e in waiting:
            if e[SOURCE] != self.driver:
                continue
            if e[US] + self.within_us >= done:
                wait.append(e)
                continue
            found = [self.near(e[US], streams[n], times[n]) for n in self.names]
            if all(f is not None for f in found):
                out.append((e[TIE], e[US], *(f[VALUE] for f in found)))
        oldest = min([done, *(e[US] for e in wait)]) - self.within_us
        return out, wait, [e for s in streams.values() for e in s if e[US] >= oldest], None

    def near(self, us: int, stream: list[tuple], times: list[int]) -> tuple | None:
        """Ties: the earlier event, then the smaller tie."""
        at = bisect_right(times, us)
        before = stream[bisect_left(times, times[at - 1])] if at else None
        after = stream[at] if at < len(stream) else None
        best = min((e for e in (before, after) if e), key=lambda e: abs(e[US] - us), default=None)
        return best if best and abs(best[US] - us) <= self.within_us else None


class Keyed(StatefulProcessor):
    """Runs a plan per key. With `cap`, the oldest waiting or remembered events beyond that many are dropped; with
    idle_us, a key whose last event the watermark has passed by that much is forgotten. `evicted` counts events lost."""

    def __init__(self, plan: Plan, cap: int | None, idle_us: int | None):
        self.plan, self.cap, self.idle_us = plan, cap, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.kept = handle.getListState("waiting", EVENT), handle.getListState("kept", EVENT)
        self.memory, self.last = handle.getValueState("memory", self.plan.memory), handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(u), None if _plain(t) is None else int(t), _plain(v), s) for p in rows for u, t, v, s in zip(p["us"], p["tie"], p["value"], p["source"], strict=True)]
        yield from self._settled(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settled(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _capped(self, events: list[tuple]) -> tuple[list[tuple], int]:
        over = max(0, len(events) - self.cap) if self.cap else 0
        return events[over:], over

    def _settled(self, key, new: list[tuple], done: int) -> Iterator[pd.DataFrame]:
        held, kept = [tuple(e) for e in self.waiting.get()], [tuple(e) for e in self.kept.get()]
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        newest = max([self.last.get()[0]] if self.last.exists() else [], default=None)
        newest = max((e[US] for e in new), default=newest) if newest is None else max([newest, *(e[US] for e in new)])
        rows, waiting, kept, memory = self.plan.settle(_in_order(held + new), kept, memory, done)
        (waiting, lost), (kept, more) = self._capped(waiting), self._capped(kept)
        lost += more
        if self.idle_us is not None and not waiting and newest is not None and newest + self.idle_us < done:
            lost += len(kept)
            for state in (self.waiting, self.kept, self.memory, self.last):
                state.clear()
        else:
            for state, events in ((self.waiting, waiting), (self.kept, kept)):
                if events:
                    state.put(events)
                else:
                    state.clear()
            if memory is not None:
                self.memory.update(memory)
            if newest is not None:
                self.last.update((newest,))
            if waiting:
                self.handle.registerTimer(max(waiting[0][US] + self.plan.lead_us, done) // 1000 + 1)
            if self.idle_us is not None and newest is not None:
                self.handle.registerTimer(max(newest + self.idle_us, done) // 1000 + 1)
        rows = [(*key, *r, 0) for r in rows]
        if lost:
            rows.append((*key, *[None] * (len(self.plan.columns.split(","))), lost))
        names = ["key", *(c.split()[0].strip("`") for c in self.plan.columns.split(", ")), "evicted"]
        yield pd.DataFrame(rows, columns=names, dtype=object)

    def close(self) -> None:
        pass


def _run(events: DataFrame, key: str, plan: Plan, cap: int | None, idle_us: int | None) -> DataFrame:
    """The plan over events (key, ts, us, tie, value, source). Without bounds, nothing is evicted and no column says so."""
    kind = events.schema["key"].dataType.simpleString()
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # list states and timers need it
    out = events.filter("us IS NOT NULL").groupBy("key").transformWithStateInPandas(Keyed(plan, cap, idle_us), f"key {kind}, {plan.columns}, evicted long", "append", "eventTime")
    out = out.withColumnRenamed("key", key)
    return out if cap or idle_us is not None else out.drop("evicted")


def _events(stream: DataFrame, key: str, ts: str, tie: str, value: str, source=None) -> DataFrame:
    return stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"), (F.lit("") if source is None else source).cast("string").alias("source"))


def _tagged(left: DataFrame, rights: dict[str, DataFrame], *columns: str) -> DataFrame:
    out = _events(left, *columns, F.lit(""))
    for name, right in rights.items():
        out = out.unionByName(_events(right, *columns, F.lit(name)))
    return out


def tumbling_count(stream: DataFrame, size: int, key: str, ts: str, tie: str, value: str, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, window_id, n, total): sums of each `size` events of a key in event order. The open window stays in the state."""
    return _run(_events(stream, key, ts, tie, value), key, TumblingCount(size), cap, idle_us)


def sliding_count(stream: DataFrame, size: int, key: str, ts: str, tie: str, value: str, how: str = "mean", slide: int | None = None, mode: str = "min_rows", cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, tie, us, agg): sum, mean, max, min or count of the last `size` values at each event, as the batch operator has
    it: min_rows: once the frame has `slide` rows; every_slide: at each slide-th event. The state is a ring of `size`."""
    if size < 1 or (slide is not None and slide < 1) or mode not in ("min_rows", "every_slide"):
        raise ValueError("size and slide must be positive, mode min_rows or every_slide")
    return _run(_events(stream, key, ts, tie, value), key, SlidingCount(size, slide or size, mode, how), cap, idle_us)


def tumbling_anchored(stream: DataFrame, size_us: int, key: str, ts: str, tie: str, value: str, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, window_id, n, first_us, last_us, sum): windows anchored at a key's first event; the event that reaches the
    size closes the window, belongs to it and anchors the next. The state is one open window."""
    return _run(_events(stream, key, ts, tie, value), key, Anchored(size_us), cap, idle_us)


def throttled(stream: DataFrame, key: str, ts: str, tie: str, value: str, size_us: int, slide_us: int, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, tie, us, total): the sum over the last size_us, peers included, at the events that come at least slide_us
    after the last one given out."""
    return _run(_events(stream, key, ts, tie, value), key, Throttled(size_us, slide_us), cap, idle_us)


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, value: str, tolerance_us: int, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, tie, us, right_value): each left row with the last right value at or before it within the tolerance, null if
    there is none. The state is one right value and the rows that wait."""
    return _run(_tagged(left, {"right_value": right}, key, ts, tie, value), key, Latest(["right_value"], "", tolerance_us, False), cap, idle_us)


def asof_many(left: DataFrame, rights: dict[str, DataFrame], key: str, ts: str, tie: str, value: str, tolerance_us: int | None = None, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, tie, us, and a column per name): each left row with the last value of every named right stream at or before
    it, where all of them have one within the tolerance."""
    return _run(_tagged(left, rights, key, ts, tie, value), key, Latest(list(rights), "", tolerance_us, True), cap, idle_us)


def nearest_many(left: DataFrame, rights: dict[str, DataFrame], key: str, ts: str, tie: str, value: str, window_us: int, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, tie, us, and a column per name): each left row with the nearest value of every named right stream, where all
    of them have one within window_us. A buffer per stream holds what later left rows may still reach."""
    return _run(_tagged(left, rights, key, ts, tie, value), key, Nearest(list(rights), "", window_us), cap, idle_us)


def last_known(stream: DataFrame, names: Sequence[str], key: str, ts: str, tie: str, value: str, source: str = "stream", retention_us: int | None = None, cap: int | None = None, idle_us: int | None = None) -> DataFrame:
    """(key, tie, us, and a column per name): on every event the latest value of each named stream of its key, null before
    its first or past the retention. The state is one value per name and the events that wait."""
    return _run(_events(stream, key, ts, tie, value, F.col(source)), key, Latest(list(names), None, retention_us, False), cap, idle_us)


def evictions(out: DataFrame, name: str) -> DataFrame:
    """The rows of an operator with bounds, whose micro-batches count what was evicted: in the query's progress under `name`."""
    return out.observe(name, F.coalesce(F.sum("evicted"), F.lit(0)).alias("evicted"), F.count(F.when(F.col("evicted") == 0, 1)).alias("rows")).filter("evicted = 0").drop("evicted")


def buffer_status(query) -> list[dict]:
    """Of each stateful operator in a query's last progress: rows held, bytes used, rows updated and removed."""
    last = query.lastProgress or {}
    names = {"numRowsTotal": "rows", "memoryUsedBytes": "bytes", "numRowsUpdated": "updated", "numRowsRemoved": "removed"}
    return [{new: op.get(old, 0) for old, new in names.items()} for op in last.get("stateOperators", [])]
