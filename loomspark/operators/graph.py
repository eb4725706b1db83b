"""Aggregation over neighbours and edges of graphs held as node and edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may go without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names."""
    _folder(df)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to that folder and read again, for tables that `dropped` deletes later."""
    path = f"{_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of `staged` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_AGG = {"mean": F.sum, "sum": F.sum, "max": F.max}


def neighbor_aggregate(nodes: DataFrame, edges: DataFrame, features: list[str], how: str = "mean", hops: int = 1, weight: str | None = None, normalise: str = "degree") -> DataFrame:
    """(id, features): mean, sum or max of the features of each node's in-neighbours; 0 for isolated nodes; `hops` times.

    edges: dst, src and a weight column. mean divides by max(degree, 1), or by the weights' sum if normalise is
    "weight". Pre-aggregated before the shuffle, so hub nodes are no burden. Between hops the result is checkpointed.
    """
    x = nodes.select("id", *features)
    e = edges.select("dst", "src", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    for hop in range(hops):
        m = e.join(x, e.src == x.id).select("dst", "w", *(F.col(f) * F.col("w") if weight else F.col(f).cast("double") for f in features))
        m = m.toDF("dst", "w", *features)
        total = m.groupBy("dst").agg(*(_AGG[how](f).alias(f) for f in features), F.count(F.lit(1)).alias("_deg"), F.sum("w").alias("_w"))
        by: Column = F.col("_w") if normalise == "weight" else F.greatest(F.col("_deg"), F.lit(1))
        value = [F.coalesce(F.col(f"_m.{f}") / by if how == "mean" else F.col(f"_m.{f}"), F.lit(0.0)).alias(f) for f in features]
        x = nodes.select("id").join(total.alias("_m"), F.col("id") == F.col("_m.dst"), "left").select("id", *value)
        if hops > 2 and hop % 2:
            x = checkpointed(x)
    return x


def edge_softmax(nodes: DataFrame, edges: DataFrame, features: list[str], slope: float = 0.2) -> DataFrame:
    """(id, features): sums of source features weighted by the softmax of LeakyReLU(score) over each node's in-edges;
    0 for isolated nodes. edges: dst, src, score. Two pre-aggregated passes, maximum and sums, instead of a window."""
    s = F.col("score").cast("double")
    e = edges.select("dst", "src", F.when(s > 0, s).otherwise(slope * s).alias("s"))
    top = e.groupBy(F.col("dst").alias("_d")).agg(F.max("s").alias("top"))
    x = nodes.select(F.col("id").alias("_id"), *features)
    w = e.join(top, e.dst == top._d).withColumn("w", F.exp(F.col("s") - F.col("top")))
    sums = w.join(x, F.col("src") == F.col("_id")).groupBy("dst").agg(F.sum("w").alias("_w"), *(F.sum(F.col("w") * F.col(f)).alias(f) for f in features))
    return nodes.select("id").join(sums.alias("m"), F.col("id") == F.col("m.dst"), "left").select("id", *(F.coalesce(F.col(f"m.{f}") / F.col("m._w"), F.lit(0.0)).alias(f) for f in features))


def graph_pool(nodes: DataFrame, graphs: DataFrame, group: str, features: list[str], how: str = "mean") -> DataFrame:
    """(group, features) for every row of graphs; 0 for empty ones."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    pooled = nodes.groupBy(group).agg(*(agg(f).alias(f) for f in features))
    return graphs.select(group).distinct().join(pooled, group, "left").na.fill(0.0, features)
