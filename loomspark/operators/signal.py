"""Filters, positions and distributions over ordered series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from ..functions.timeutil import DAY, micros, ordered_index, time_bucket


def positional(position: Column, dims: int) -> dict[str, Column]:
    """sin and cos of position * 10000^(-2i / dims): columns sin_i and cos_i."""
    out = {}
    for i in range(dims // 2):
        angle = position * math.pow(10000.0, -2 * i / dims)
        out |= {f"sin_{i}": F.sin(angle), f"cos_{i}": F.cos(angle)}
    return out


def receptive_field(kernel: int, dilations: Sequence[int]) -> int:
    """Rows a stack of causal filters looks at: the halo of a block plus one."""
    return 1 + (kernel - 1) * sum(dilations)


#: Rows of a block of a series.
BLOCK = 100_000


def causal_stack(df: DataFrame, layers: Sequence[tuple[Sequence[float], int]], value: str, keys: Sequence[str], order: Sequence[str], out: str = "filtered", bucket: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Causal filters one after the other: each of `layers` is (weights, dilation) and gives
    y[t] = sum of w_j * x[t - j * dilation], zero before the series' start; null values count as zero.

    Rows are numbered per key and cut into blocks, each with the rows before it that the stack looks at, so that a long
    series is many tasks' work. bucket must not decrease along `order` (see ordered_index); without one, days of a
    timestamp are taken, and for any other order a key is numbered by one task, though filtered by many.
    """
    halo = sum(receptive_field(len(weights), [dilation]) - 1 for weights, dilation in layers)
    block = max(block, halo, 1)
    if bucket is None:
        bucket = time_bucket(micros(order[0]), DAY) if df.schema[order[0]].dataType.typeName().startswith("timestamp") else F.lit(0)
    place, part, own, x = (unused(df, n) for n in ("_place", "_part", "_own", "_x"))
    rows = ordered_index(df, keys, list(order), bucket, place).withColumn(part, F.floor(F.col(place) / block)).withColumn(x, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    before = rows.filter(F.col(place) % block >= block - halo).withColumn(part, F.col(part) + 1)
    both = rows.withColumn(own, F.lit(True)).unionByName(before.withColumn(own, F.lit(False)))
    w = Window.partitionBy(*keys, part).orderBy(place)
    for weights, dilation in layers:
        terms = [F.coalesce(F.lag(x, j * dilation).over(w) if j else F.col(x), F.lit(0.0)) * c for j, c in enumerate(weights)]
        both = both.withColumn(x, reduce(lambda a, b: a + b, terms))
    return both.filter(own).withColumn(out, F.col(x)).drop(place, part, own, x)


def causal_filter(df: DataFrame, weights: Sequence[float], value: str, keys: Sequence[str], order: Sequence[str], dilation: int = 1, out: str = "filtered", bucket: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One layer of causal_stack."""
    return causal_stack(df, [(weights, dilation)], value, keys, order, out, bucket, block)


def nucleus(df: DataFrame, seq: str, item: str, logit: str, top_k: int | None = None, top_p: float | None = None, temperature: float = 1.0) -> DataFrame:
    """(seq, item, prob) of kept items: the k largest logits, ties kept; of these, while the probability before an item
    is at most p, the first always. Probabilities are softmax over what top-k keeps. Temperature 0 keeps the best item."""
    if temperature == 0:
        return df.groupBy(seq).agg(F.max_by(item, F.struct(F.col(logit), -F.col(item))).alias(item)).withColumn("prob", F.lit(1.0))
    x = df.select(seq, item, (F.col(logit) / temperature).alias("l"))
    if top_k is not None:
        x = x.withColumn("r", F.rank().over(Window.partitionBy(seq).orderBy(F.desc("l")))).filter(F.col("r") <= top_k).drop("r")
    every = Window.partitionBy(seq)
    x = x.withColumn("e", F.exp(F.col("l") - F.max("l").over(every))).withColumn("prob", F.col("e") / F.sum("e").over(every))
    if top_p is not None:
        before = Window.partitionBy(seq).orderBy(F.desc("l"), item).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("b", F.coalesce(F.sum("prob").over(before), F.lit(0.0))).filter(F.col("b") <= top_p)
    return x.select(seq, item, "prob")


def stopping_pmf(df: DataFrame, key: str, order: Sequence[str], hazard: str) -> DataFrame:
    """df with pmf: p_n = h_n * product of (1 - h_i) before; what remains falls to the last step."""
    w = Window.partitionBy(key).orderBy(*order)
    alive = F.coalesce(F.product(1 - F.col(hazard)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn("pmf", F.when(last, alive).otherwise(alive * F.col(hazard)))


def geometric_kl(pmf: DataFrame, key: str, step: str = "n") -> DataFrame:
    """(key, mean_steps, kl): expected steps and KL of the stopping distribution from the geometric one of that mean."""
    p, n = F.col("pmf"), F.col(step)
    log_p = F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    g = pmf.groupBy(key).agg(F.sum(p * n).alias("mean_steps"), log_p.alias("_pl"), F.sum(p).alias("_p"))
    q = 1 / F.col("mean_steps")
    rest = F.when(q < 1, (F.col("mean_steps") - F.col("_p")) * F.log(F.when(q < 1, 1 - q))).otherwise(0.0)
    return g.select(key, "mean_steps", (F.col("_pl") - rest - F.col("_p") * F.log(q)).alias("kl"))
