"""Exact-size reproducible sampling. A row's draw is a hash of seed and id, so a sample is a set, the same on any cluster."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from ..functions.ordered import walk

STEPS = 1 << 48


def uniform_int(seed: str | int, id_col: str | Column) -> Column:
    """48 bits of md5(seed:id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 12), 16, 10).cast("bigint")


def uniform(seed: str | int, id_col: str | Column) -> Column:
    """In [0, 1); never 0 exactly, so that its logarithm exists."""
    return F.greatest(uniform_int(seed, id_col), F.lit(1)) / F.lit(float(STEPS))


def row_id(df: DataFrame, id_col: str) -> Column:
    """The id as a string; of a row without one, a hash of the row, so that such rows have draws of their own."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = [F.col(c) for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.xxhash64(*plain).cast("string")))


def epoch_seed(seed: str | int, epoch: int) -> str:
    """The seed of an epoch's draws: another sample each epoch, the same again after a reset to an epoch."""
    return f"{seed}/{epoch}"


def smallest(df: DataFrame, size: int, value: Column, id_col: str) -> DataFrame:
    """The `size` rows of least (value, id); value is positive. Rows without a value are left out.

    A histogram of the values' logarithms, 64 bins to a doubling, gives the bin that holds the last of them. Rows of
    lower bins stay where they are; only that bin, about a hundredth of `size` where values are evenly dense, is sorted.
    """
    v = value.cast("double")
    binned = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), v.alias("v"), F.col(id_col).alias("id")).filter("v IS NOT NULL")
    binned = binned.withColumn("b", F.floor(64 * F.log2(F.greatest("v", F.lit(1e-300)))))
    counts = binned.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    upto = counts.select("b", "k", F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))  # a row per bin
    last = upto.filter(F.col("upto") >= size).orderBy("b").first()
    if last is None:
        return binned.select("row.*")
    edge = binned.filter(F.col("b") == last["b"]).orderBy("v", "id").limit(size - (last["upto"] - last["k"]))
    return binned.filter(F.col("b") < last["b"]).unionByName(edge).select("row.*")


def sample_uniform(df: DataFrame, size: int, id_col: str, seed: int | str = 0) -> DataFrame:
    """min(size, rows) distinct rows: those of the smallest hashes."""
    return smallest(df, size, uniform_int(seed, row_id(df, id_col)) + 1, id_col)


#: Rows up to which a table of labels, which was just counted, is sent to every executor.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """df, one row per label, with a broadcast hint if it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


#: Parts of the range of draws that a class's histogram has.
BINS = 4096


def _by_quota(df: DataFrame, quotas: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Of each class (null is one) the quota's first rows by hash. A histogram of each class's draws gives the bin that
    holds the last of them; only rows up to it are ranked, so a hot class is not sorted whole."""
    row = F.struct(*(F.col(c) for c in df.columns)).alias("row")
    drawn = df.select(row, F.col(label).alias("c"), F.col(id_col).alias("id"), uniform_int(seed, row_id(df, id_col)).alias("u"))
    drawn = drawn.withColumn("bin", F.floor(F.col("u") / F.lit(STEPS // BINS)))
    want = few(quotas.select(F.col(label).alias("of"), "quota"))
    held = drawn.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("k"))
    held = held.withColumn("upto", F.sum("k").over(Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    held = held.join(want, F.col("c").eqNullSafe(F.col("of")))
    bounds = held.groupBy("of").agg(F.first("quota").alias("quota"), F.min(F.when(F.col("upto") >= F.col("quota"), F.col("bin"))).alias("edge"))
    near = drawn.join(few(bounds), F.col("c").eqNullSafe(F.col("of"))).filter(F.col("bin") <= F.coalesce("edge", F.lit(BINS)))
    rank = F.row_number().over(Window.partitionBy("c").orderBy("u", "id"))
    return near.withColumn("r", rank).filter(F.col("r") <= F.col("quota")).select("row.*")


def stratified(df: DataFrame, size: int, label: str, id_col: str, seed: int = 0) -> DataFrame:
    """Per class max(1, floor(size * share)) rows, then at most `size` of them by a second hash. Null is a class."""
    counts = class_counts(df, label)
    total = F.sum("n").over(Window.partitionBy())  # over one row per class
    quotas = counts.select(label, F.greatest(F.lit(1), F.floor(size * F.col("n") / total)).alias("quota"))
    return smallest(_by_quota(df, quotas, label, id_col, seed), size, uniform_int(f"{seed}b", row_id(df, id_col)) + 1, id_col)


def balanced(df: DataFrame, size: int, label: str, id_col: str, seed: int = 0) -> DataFrame:
    """size div classes rows of each class, the remainder to the first classes; a class with too few gives all it has."""
    counts = class_counts(df, label)
    w = Window.orderBy(label)  # over one row per class
    k = F.count(F.lit(1)).over(Window.partitionBy())
    quotas = counts.select(label, (F.floor(F.lit(size) / k) + (F.row_number().over(w) <= F.lit(size) % k).cast("int")).alias("quota"))
    return _by_quota(df, quotas, label, id_col, seed)


def weighted(df: DataFrame, size: int, weight: Column, id_col: str, seed: int = 0) -> DataFrame:
    """min(size, rows with weight > 0) rows, drawn one after another by weight without replacement: the smallest of
    -ln(u) / weight (Efraimidis and Spirakis)."""
    return smallest(df.filter(weight.cast("double") > 0), size, -F.log(uniform(seed, row_id(df, id_col))) / weight.cast("double"), id_col)


def class_weighted(df: DataFrame, size: int, label: str, weights: dict, id_col: str, seed: int | str = 0, default: float = 1.0) -> DataFrame:
    """Weighted by class weights given by the caller; classes that are not named have the default."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for item in weights.items() for x in item))[F.col(label)], F.lit(default)) if weights else F.lit(default)
    return weighted(df, size, weight, id_col, seed)


#: Rows that one bucket of a draw with replacement or of batches should hold.
BUCKET_ROWS = 1_000_000


def with_replacement(df: DataFrame, size: int, id_col: str, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """`size` draws as rows of df with `draw`: uniform, or by weight. Rows lie on a line by their weights, bucket after
    bucket by hash; a draw is a place on it. An equi-join finds a draw's bucket, a window over the bucket its row."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    id_ = row_id(df, id_col)
    rows = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.col(id_col).alias("key"), id_.alias("id"), w.alias("w")).filter("w > 0")
    buckets = 1 << max(8, (rows.count() // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.floor(uniform_int(f"{seed}p", "id") / F.lit(STEPS / buckets)))
    spans = rows.groupBy("bucket").agg(F.sum("w").alias("span"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # over a row per bucket
    spans = spans.select("bucket", F.sum("span").over(order).alias("to"), "span", F.sum("span").over(Window.partitionBy()).alias("all"))
    # A piece of the weights' line is as long as a bucket's span on average. Each piece lists the buckets that reach into
    # it, about two, and each draw asks its piece alone.
    spans = spans.withColumns({"from": F.col("to") - F.col("span"), "piece": F.col("all") / buckets})
    last = F.least(F.floor(F.col("to") / F.col("piece")), F.lit(buckets))
    spans = spans.withColumn("at", F.explode(F.sequence(F.least(F.floor(F.col("from") / F.col("piece")), F.lit(buckets)), last)))
    whole = rows.agg(F.sum("w")).first()[0]  # of the draws' scale alone
    draws = df.sparkSession.range(size if whole else 0).select(F.col("id").alias("draw"), uniform(f"{seed}r", "id").alias("u"))
    draws = draws.withColumn("at", F.least(F.floor(F.col("u") * buckets), F.lit(buckets)))
    near = draws.join(spans.select("at", "bucket", "from", "to", "all"), "at").filter((F.col("u") * F.col("all") < F.col("to")) & (F.col("u") * F.col("all") >= F.col("from")))
    at = near.select("draw", "bucket", (F.col("u") * F.col("all") - F.col("from")).alias("place"), F.lit(1).alias("side"))
    inside = Window.partitionBy("bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.select("bucket", F.coalesce(F.sum("w").over(inside), F.lit(0.0)).alias("place"), F.lit(0).alias("side"), "row")
    both = held.unionByName(at, allowMissingColumns=True)
    last = F.last("row", ignorenulls=True).over(Window.partitionBy("bucket").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("row", last).filter("side = 1").select("draw", "row.*")


def class_weights(df: DataFrame, label: str, how: str = "inverse", beta: float = 0.999) -> DataFrame:
    """(label, n, weight), weights summing to the number of classes. how: inverse, inverse_sqrt or effective."""
    n = F.col("n").cast("double")
    raw = {"inverse": 1 / n, "inverse_sqrt": 1 / F.sqrt(n), "effective": (1 - beta) / (1 - F.pow(F.lit(beta), n))}[how]
    all_classes = Window.partitionBy()
    return class_counts(df, label).withColumn("_raw", raw).select(label, "n", (F.col("_raw") * F.count(F.lit(1)).over(all_classes) / F.sum("_raw").over(all_classes)).alias("weight"))


def difficulty(losses: DataFrame, id_col: str, order: list[str], loss: str, keep: float = 0.9) -> DataFrame:
    """(id, difficulty, last_loss): d = (1 - keep) * loss + keep * d in order, seeded by the first loss.

    A step is affine in d, so a block of losses is one factor and one offset. Rows are range-partitioned by id and order:
    a hot id spreads over tasks, each of which folds its block, and only an id's blocks, one per task, meet in a row.
    """
    seen = [f"o{i}" for i in range(len(order))]
    slim = losses.select(F.col(id_col).alias("k"), *(F.col(o).alias(s) for o, s in zip(order, seen, strict=True)), F.col(loss).cast("double").alias("x"))
    kind = slim.schema["k"].dataType.simpleString()
    names, kinds = ["k", "part", "seeded", "factor", "shift", "last"], [pa.int64(), *[pa.float64()] * 4]

    class Block:
        def __init__(self):
            # d where the block is an id's first; else d becomes factor * d + shift.
            self.seeded, self.factor, self.shift, self.last, self.begun = None, 1.0, 0.0, None, False

        def step(self, x):
            add = None if x is None else (1 - keep) * x
            self.seeded = x if not self.begun else None if add is None or self.seeded is None else add + keep * self.seeded
            self.shift = None if add is None or self.shift is None else add + keep * self.shift
            self.factor, self.last, self.begun = keep * self.factor, x, True
            return ()

        def end(self):
            return [(TaskContext.get().partitionId(), self.seeded, self.factor, self.shift, self.last)]

    dealt = slim.repartitionByRange("k", *seen).sortWithinPartitions("k", *seen).select("k", "x")
    blocks = dealt.mapInArrow(walk(Block, names, kinds), f"k {kind}, part long, seeded double, factor double, shift double, last double")
    g = blocks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "seeded", "factor", "shift", "last"))).alias("_s"))
    ema = F.aggregate(F.slice("_s", 2, F.size("_s")), F.col("_s")[0]["seeded"], lambda d, b: b["factor"] * d + b["shift"])
    return g.select(F.col("k").alias(id_col), ema.alias("difficulty"), F.element_at("_s", -1)["last"].alias("last_loss"))


def _scored(df: DataFrame, id_col: str, scores: DataFrame, score: str, name: str) -> DataFrame:
    """df with its rows' scores as `name`; of an id's several scores the largest."""
    own, joined = scores.groupBy(F.col(id_col).alias("_id_")).agg(F.max(score).alias("_score_")), unused(df, "_scored")
    of = own.select(F.struct(F.col("_id_").alias("id"), F.col("_score_").alias("score")).alias(joined))
    return df.join(of, df[id_col] == of[joined]["id"], "left").withColumn(name, F.col(joined)["score"]).drop(joined)


def focal(df: DataFrame, size: int, id_col: str, label: str, scores: DataFrame | None, gamma: float = 2.0, seed: int = 0) -> DataFrame:
    """Weighted by difficulty (1 where unknown), or by 1 / class count if there are no scores; to the power gamma."""
    name = unused(df, "_d")
    if scores is None:
        of = few(class_counts(df, label)).select(F.struct(F.col(label).alias("of"), "n").alias(name))
        joined = df.join(of, df[label].eqNullSafe(of[name]["of"])).withColumn(name, 1.0 / F.col(name)["n"])
    else:
        joined = _scored(df, id_col, scores, "difficulty", name)
    return weighted(joined, size, F.pow(F.coalesce(name, F.lit(1.0)), F.lit(gamma)), id_col, seed).select(df.columns)


def adaptive(df: DataFrame, size: int, id_col: str, label: str, scores: DataFrame, epoch: int, seed: int = 0, warmup: int = 5) -> DataFrame:
    """Stratified before epoch `warmup`, then weighted by the last loss between 0.1 and 10 (1 where unknown)."""
    if epoch < warmup:
        return stratified(df, size, label, id_col, seed)
    name = unused(df, "_d")
    w = F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(10.0), name)), F.lit(1.0))
    return weighted(_scored(df, id_col, scores, "last_loss", name), size, w, id_col, seed).select(df.columns)


def batches(df: DataFrame, size: int, id_col: str, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """df with a batch number: every row once, in hash order, `size` rows a batch. Numbered in two levels, by hash range."""
    from ..functions.timeutil import ordered_index

    u = df.withColumn("_u", uniform_int(seed, id_col))
    ranges = 1 << max(8, (df.count() // BUCKET_ROWS).bit_length())
    out = ordered_index(u, [], ["_u", id_col], F.floor(F.col("_u") / F.lit(STEPS // ranges)), "_i").withColumn("batch", F.floor(F.col("_i") / size))
    if drop_last:
        out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))), F.col("batch") < F.floor(F.col("_n") / size)).drop("_n")
    return out.drop("_u", "_i")


def sampling_stats(df: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(label, original, sampled, ratio): ratio of the class's share in the sample to its share in df."""
    o, s = class_counts(df, label).withColumnRenamed("n", "original"), sample.groupBy(label).agg(F.count(F.lit(1)).alias("sampled"))
    joined = o.join(s, label, "left").na.fill(0, ["sampled"])
    everything = Window.partitionBy()  # over one row per class
    return joined.withColumn("ratio", (F.col("sampled") / F.sum("sampled").over(everything)) / (F.col("original") / F.sum("original").over(everything)))
