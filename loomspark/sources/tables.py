"""Sources and sinks of event tables, batch and streaming, and their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the asked columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_stream(spark: SparkSession, path: str, schema: StructType | str, ts: str, delay: str, max_files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream with a watermark on its event time. max_files limits what a micro-batch takes in."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(path)
    if dict(df.dtypes)[ts] != "timestamp":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay)


def union_streams(streams: dict[str, DataFrame], name: str = "stream") -> DataFrame:
    """Rows of all streams with their stream's name."""
    return reduce(DataFrame.unionByName, (df.withColumn(name, F.lit(n)) for n, df in streams.items()))


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df whose next action also gives named counts, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(n) for n, c in counts.items())), seen
