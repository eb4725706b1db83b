"""Exact quantiles without a map of values per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram, and how many histograms narrow the values down before what is left is sorted.
BINS, ROUNDS = 1024, 2


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile") -> DataFrame:
    """(keys, out): the q-quantile of the values that are not null, interpolated between neighbours; null without any.

    Histograms between a group's least and largest value find the bins that hold the two ranks asked for, once more inside
    those bins, and only the rows left are sorted, within group and bin. A group is never one task's work, unless most of
    its rows agree to within a millionth of its range. Null keys are a group; infinities and NaN are not supported.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    named = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    groups = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).distinct()
    sizes = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.lit(q) * (F.col("n") - 1)
    # Two ranks per group, each with the span of values that holds it and how many values are less than the span.
    spans = sizes.select(*named, "low", "high", F.lit(0).cast("long").alias("less"), F.explode(F.array(F.struct(F.floor(place).alias("rank"), (1 - (place - F.floor(place))).alias("share")), F.struct(F.ceil(place).alias("rank"), (place - F.floor(place)).alias("share")))).alias("want"))
    spans = spans.select(*named, "low", "high", "less", F.col("want.rank").alias("rank"), F.col("want.share").alias("share")).groupBy(*named, "low", "high", "less", "rank").agg(F.max("share").alias("share"))
    for _ in range(ROUNDS):
        inside = rows.alias("r").join(spans.alias("s"), [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in named] + [F.col("v") >= F.col("low"), F.col("v") <= F.col("high")])
        width = F.col("high") - F.col("low")
        part = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        bins = inside.select(*(F.col(f"s.{n}").alias(n) for n in named), "low", "high", "less", "rank", "share", part.alias("bin"), "v")
        bins = bins.groupBy(*named, "low", "high", "less", "rank", "share", "bin").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = F.col("less") + F.coalesce(F.sum("k").over(Window.partitionBy(*named, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("k")))
        spans = found.select(*named, F.col("from").alias("low"), F.col("to").alias("high"), F.col("before").alias("less"), "rank", "share")
    # A span of one value needs no sort.
    flat = spans.filter("low = high").select(*named, "share", F.col("low").alias("v"))
    left = rows.alias("r").join(spans.filter("low < high").alias("s"), [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in named] + [F.col("v") >= F.col("low"), F.col("v") <= F.col("high")])
    left = left.select(*(F.col(f"s.{n}").alias(n) for n in named), "less", "rank", "share", "v")
    at = F.col("less") + F.row_number().over(Window.partitionBy(*named, "rank").orderBy("v")) - 1
    picked = left.withColumn("at", at).filter("at = rank").select(*named, "share", "v").unionByName(flat)
    total = picked.groupBy(*named).agg(F.sum(F.col("share") * F.col("v")).alias("_q"))
    g, t = groups.alias("g"), total.alias("t")
    joined = g.join(t, [F.col(f"g.{n}").eqNullSafe(F.col(f"t.{n}")) for n in named], "left") if named else total
    return joined.select(*(F.col(f"g.{n}").alias(k) for k, n in zip(keys, named, strict=True)), F.col("_q").alias(out))
