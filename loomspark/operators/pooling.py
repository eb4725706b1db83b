"""Pooling of grouped elements with masks and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padding_mask(tokens: str, pad: int) -> Column:
    """array<boolean>: token is not the pad id."""
    return F.transform(tokens, lambda t: t != pad)


def masked_pool(df: DataFrame, group: str, vector: str, valid: Column, how: str = "mean") -> DataFrame:
    """(group, pos, value) over valid elements. Without any: mean and sum 0, max -1e9."""
    x = df.select(group, valid.alias("ok"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    kept = F.when(F.col("ok"), F.col("x"))
    value = {"mean": F.coalesce(F.sum(kept), F.lit(0.0)) / F.greatest(F.count(kept).cast("double"), F.lit(1e-9)), "sum": F.coalesce(F.sum(kept), F.lit(0.0)), "max": F.coalesce(F.max(kept), F.lit(-1e9))}[how]
    return x.groupBy(group, "pos").agg(value.alias("value"))


def attention_pool(df: DataFrame, group: str, vector: str, score: Column) -> DataFrame:
    """(group, pos, value): vectors weighted by the softmax of score within the group; a maximum, then sums."""
    s = df.select(group, score.cast("double").alias("s"), F.col(vector).cast("array<double>").alias("v"))
    top = s.groupBy(F.col(group).alias("_g")).agg(F.max("s").alias("top"))
    w = s.join(top, F.col(group) == F.col("_g")).select(group, F.exp(F.col("s") - F.col("top")).alias("w"), F.posexplode("v").alias("pos", "x"))
    return w.groupBy(group, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))


def pair_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with mean_diff and mean_product: the means over the group's elements j of x - x_j and x * x_j. They equal
    x - mean and x * mean, so no pairs are made."""
    means = df.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_m"))
    j = df.join(means, F.col(group).eqNullSafe(F.col("_g")))
    return j.withColumn("mean_diff", F.col(value) - F.col("_m")).withColumn("mean_product", F.col(value) * F.col("_m")).drop("_g", "_m")
