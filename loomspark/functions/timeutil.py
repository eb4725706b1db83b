"""Event time in microseconds, and row numbers that no single task has to count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a zone (session zone: UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("long")


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "idx") -> DataFrame:
    """Adds the 0-based position of each row within `keys` by `order`, null keys forming one group. A column of df that is
    called `name` is replaced; see unused().

    bucket must not decrease along `order`. Rows are numbered within (keys, bucket); the running count of earlier
    buckets comes from a table with one row per key and bucket. So a key with a third of all rows, or no key at all,
    is numbered by many tasks.
    """
    keys, part, place = list(keys), unused(df, f"{name}_part"), unused(df, f"{name}_before")
    b = df.withColumn(part, bucket)
    counts = b.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(part).alias("b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))
    offsets = counts.select(at.alias(place))
    match = b[part].eqNullSafe(offsets[place]["b"])
    for i, k in enumerate(keys):
        match = match & b[k].eqNullSafe(offsets[place][f"k{i}"])
    inside = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)) - 1
    return b.withColumn(name, inside).join(offsets, match).withColumn(name, F.col(name) + F.col(place)["before"]).drop(part, place)
