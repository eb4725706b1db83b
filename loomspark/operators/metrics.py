"""Losses and divergences as grouped aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, normalized, total


def info_nce(views: DataFrame, batch: str, pair: str, view: str, vector: str, temperature: float, label: str | None = None) -> DataFrame:
    """(batch, loss): mean over a batch's views of -log(exp(s_pos / t) / sum over others of exp(s / t)).

    Positives share the pair id, or the label if one is given (then the mean over them). The pair join is within
    batches, whose size the training fixes; log-sum-exp is shifted by the maximum cosine 1.
    """
    v = views.select(batch, pair, view, *([label] if label else []), normalized(F.col(vector).cast("array<double>")).alias("_vec"))
    a, b = v.alias("a"), v.alias("b")
    other = (F.col(f"a.{batch}") == F.col(f"b.{batch}")) & ~((F.col(f"a.{pair}") == F.col(f"b.{pair}")) & (F.col(f"a.{view}") == F.col(f"b.{view}")))
    s = dot(F.col("a._vec"), F.col("b._vec")) / temperature
    positive = F.col(f"a.{label}") == F.col(f"b.{label}") if label else F.col(f"a.{pair}") == F.col(f"b.{pair}")
    p = a.join(b, other).select(F.col(f"a.{batch}").alias(batch), F.col(f"a.{pair}").alias("_p"), F.col(f"a.{view}").alias("_w"), s.alias("s"), positive.alias("pos"))
    each = p.groupBy(batch, "_p", "_w").agg(F.avg(F.when(F.col("pos"), F.col("s"))).alias("s"), (F.log(F.sum(F.exp(F.col("s") - 1 / temperature))) + 1 / temperature).alias("z"))
    return each.filter("s IS NOT NULL").groupBy(batch).agg(F.avg(F.col("z") - F.col("s")).alias("loss"))


def queue_loss(pairs: DataFrame, queue: DataFrame, query: str, key: str, vector: str, temperature: float, queue_rows: int = 65_536) -> DataFrame:
    """One row (n, loss): cross entropy of the positive logit against a stored queue of negatives.

    The queue is FIFO and of fixed capacity; more than queue_rows rows are an error, so it is safe to broadcast. Arrow
    batches of pairs meet it in blocks, as matrix products. Pairs and queue rows with a null vector do not count.
    """
    held = queue.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).limit(queue_rows + 1).toArrow()
    if held.num_rows > queue_rows:
        raise ValueError("the queue is over its capacity")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    negatives = unit(np.array(held.column("v").to_pylist(), np.float64)) if held.num_rows else None
    sent = pairs.sparkSession.sparkContext.broadcast(negatives)

    def losses(batches):
        for batch in batches:
            q, k = (unit(np.array(batch.column(i).to_pylist(), np.float64).reshape(batch.num_rows, -1)) for i in (0, 1))
            positive = (q * k).sum(1) / temperature
            z = np.exp(positive - 1 / temperature)  # shifted by the largest cosine
            for a in range(0, len(sent.value) if sent.value is not None else 0, 4096):
                z += np.exp((q @ sent.value[a : a + 4096].T - 1) / temperature).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.log(z) + 1 / temperature - positive)], names=["l"])

    vectors = pairs.select(F.col(query).cast("array<double>").alias("q"), F.col(key).cast("array<double>").alias("k")).filter("q IS NOT NULL AND k IS NOT NULL")
    return vectors.mapInArrow(losses, "l double").agg(F.count("l").alias("n"), F.avg("l").alias("loss"))


def gaussian_kl(mu: Column, logvar: Column) -> Column:
    """Of one row's arrays: -1/2 * sum(1 + logvar - mu^2 - exp(logvar))."""
    return -0.5 * total(F.zip_with(mu, logvar, lambda m, v: 1 + v - m * m - F.exp(v)))


def vae_loss(df: DataFrame, x: Column, reconstruction: Column, mu: Column, logvar: Column, beta: float = 1.0) -> DataFrame:
    """One row (n, mse, kl, loss): mean squared error over elements, KL per row, mse + beta * kl."""
    square = total(F.zip_with(x, reconstruction, lambda a, b: (a - b) * (a - b)))
    r = df.select(square.alias("s"), F.size(x).alias("d"), gaussian_kl(mu, logvar).alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.sum("s") / F.sum("d")).alias("mse"), F.avg("k").alias("kl"))
    return r.withColumn("loss", F.col("mse") + beta * F.col("kl"))
