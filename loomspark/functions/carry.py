"""The last and the next value along a key's time, without one task for all of a key's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeutil import HOUR, time_bucket


def carried(rows: DataFrame, keys: Sequence[str], us: str, order: Sequence[str], hits: Sequence[str], ahead: Sequence[str] = (), bucket_us: int = HOUR) -> DataFrame:
    """rows whose columns `hits` hold the last value that is not null at or before them, and whose columns `ahead` the
    next one after them, by (us, *order) within keys. Columns are replaced; rows without a time have no values but their own.

    Keys are cut into time buckets. One aggregate gives each bucket's last and first values, a window over the buckets
    carries them on, and each bucket gets them as one more row that comes before its own in either direction. So rows are
    sorted within key and bucket alone, frames only grow forward, and a hot key is many tasks' work.
    """
    keys = list(keys)
    dealt = rows.withColumn("_bucket", time_bucket(F.col(us), bucket_us)).withColumn("_carry", F.lit(False))
    place = F.struct(us, *order)
    own = [F.max_by(h, F.when(F.col(h).isNotNull(), place)).alias(h) for h in hits]
    own += [F.min_by(a, F.when(F.col(a).isNotNull(), place)).alias(a) for a in ahead]
    buckets = dealt.filter(F.col("_bucket").isNotNull()).groupBy(*keys, "_bucket").agg(*own)
    forth = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    handed = buckets.withColumns({h: F.last(h, ignorenulls=True).over(forth) for h in hits} | {a: F.last(a, ignorenulls=True).over(back) for a in ahead})
    handed = handed.filter(" OR ".join(f"`{c}` IS NOT NULL" for c in [*hits, *ahead])).withColumn("_carry", F.lit(True))
    both = dealt.unionByName(handed, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket")
    up = inside.orderBy(F.desc("_carry"), F.asc(us), *(F.asc(o) for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.desc("_carry"), F.desc(us), *(F.desc(o) for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    timed: Column = F.col("_bucket").isNotNull()
    out = {h: F.when(timed, F.last(h, ignorenulls=True).over(up)).otherwise(F.col(h)) for h in hits}
    out |= {a: F.when(timed, F.last(a, ignorenulls=True).over(down)) for a in ahead}
    return both.withColumns(out).filter("NOT _carry").drop("_bucket", "_carry")
