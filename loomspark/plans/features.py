"""A feature registry: named columns with dependencies and versions, resolved into one logical plan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import total

METADATA = "feature string, version string, registered_at timestamp, row_count long, dtype string, compute_hash string, dependencies array<string>, metadata map<string,string>"


@dataclass
class Feature:
    """compute: from the DataFrame, which has the feature's dependencies as columns, to a Column."""

    name: str
    compute: Callable[[DataFrame], Column]
    dependencies: Sequence[str] = ()
    version: str = "1.0"
    metadata: dict = field(default_factory=dict)

    @property
    def compute_hash(self) -> str:
        name = getattr(self.compute, "__qualname__", type(self.compute).__name__)
        return hashlib.md5(f"{name}:{self.version}".encode()).hexdigest()[:8]


class FeatureStore:
    """Features by name; the last registered version is current, earlier ones stay in the history."""

    def __init__(self):
        self._history: dict[str, list[tuple[Feature, datetime]]] = {}
        self.computed = 0
        self._kinds: dict[tuple[str, str], str] = {}

    def register(self, feature: Feature) -> None:
        """Dependencies must be registered features; a cycle is refused."""
        missing = [d for d in feature.dependencies if d not in self._history and d != feature.name]
        if missing:
            raise ValueError(f"unknown dependencies of {feature.name}: {missing}")
        trial = {n: self.current(n).dependencies for n in self._history} | {feature.name: feature.dependencies}
        self._order([feature.name], trial)
        self._history.setdefault(feature.name, []).append((feature, datetime.now(timezone.utc)))

    def current(self, name: str, version: str | None = None) -> Feature:
        for f, _ in reversed(self._history.get(name, [])):
            if version is None or f.version == version:
                return f
        raise ValueError(f"feature {name} is not registered" + (f" in version {version}" if version and name in self._history else ""))

    @staticmethod
    def _order(names: Sequence[str], graph: dict[str, Sequence[str]]) -> list[str]:
        done: list[str] = []
        open_names: list[str] = []

        def visit(n: str) -> None:
            if n in done:
                return
            if n in open_names:
                raise ValueError(f"dependency cycle: {' -> '.join([*open_names, n])}")
            if n not in graph:
                raise ValueError(f"feature {n} is not registered")
            open_names.append(n)
            for d in graph[n]:
                visit(d)
            done.append(open_names.pop())

        for n in names:
            visit(n)
        return done

    def order(self, names: Sequence[str]) -> list[str]:
        """Names and all they depend on, dependencies first."""
        return self._order(names, {n: self.current(n).dependencies for n in self._history})

    def dependencies(self, name: str) -> list[str]:
        return self.order([name])[:-1]

    def compute(self, df: DataFrame, names: Sequence[str], versions: dict[str, str] | None = None) -> DataFrame:
        """df with the named features as columns: one chain of projections, which Catalyst collapses. df is not changed.

        A column of df that has the name of a needed feature is an error, as it would hide the feature.
        """
        out, order = df, self.order(names)
        hidden = [n for n in order if n in df.columns]
        if hidden:
            raise ValueError(f"columns would hide features: {hidden}")
        for n in order:
            f = self.current(n, (versions or {}).get(n))
            out = out.withColumn(n, f.compute(out))
            self._kinds[n, f.version] = out.schema[n].dataType.simpleString()
            self.computed += 1
        return out.select(*df.columns, *dict.fromkeys(names))

    def lineage(self, spark: SparkSession) -> DataFrame:
        """(feature, dependency, depth, version, hash): every dependency with its least distance; one row without any."""
        rows = []
        for n in self._history:
            depth, level = {}, list(self.current(n).dependencies)
            while level:
                step = max(depth.values(), default=0) + 1
                for d in level:
                    depth.setdefault(d, step)
                level = [d for x in level for d in self.current(x).dependencies if d not in depth]
            f = self.current(n)
            rows += [(n, d, k, f.version, f.compute_hash) for d, k in depth.items()] or [(n, None, 0, f.version, f.compute_hash)]
        return spark.createDataFrame(rows, "feature string, dependency string, depth int, version string, hash string")

    def versions(self, spark: SparkSession) -> DataFrame:
        """Every registered version, with its type once it was computed; rows are counted by save alone."""
        rows = [(f.name, f.version, at, None, self._kinds.get((f.name, f.version)), f.compute_hash, list(f.dependencies), {str(k): str(v) for k, v in f.metadata.items()}) for h in self._history.values() for f, at in h]
        return spark.createDataFrame(rows, METADATA)

    def statistics(self, spark: SparkSession) -> DataFrame:
        n = len(self._history)
        return spark.createDataFrame([(n, sum(map(len, self._history.values())), self.computed)], "features long, versions long, computed long")

    def save(self, df: DataFrame, names: Sequence[str], path: str) -> None:
        """Values as Parquet at path/data, then versions and types at path/meta."""
        out = self.compute(df, names)
        out.write.parquet(f"{path}/data")
        n_rows = df.sparkSession.read.parquet(f"{path}/data").count()  # from the files' footers
        rows = [(n, self.current(n).version, datetime.now(timezone.utc), n_rows, out.schema[n].dataType.simpleString(), self.current(n).compute_hash, list(self.current(n).dependencies), {}) for n in names]
        df.sparkSession.createDataFrame(rows, METADATA).coalesce(1).write.parquet(f"{path}/meta")

    def load(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """(values, conflicts): saved features whose version is not the current one, with both versions."""
        meta = spark.read.parquet(f"{path}/meta")
        now = spark.createDataFrame([(n, self.current(n).version) for n in self._history] or [("", "")], "feature string, current string")
        conflicts = meta.join(F.broadcast(now), "feature", "left").filter(~F.col("version").eqNullSafe(F.col("current"))).select("feature", F.col("version").alias("saved"), "current")
        return spark.read.parquet(f"{path}/data"), conflicts

    def materialise(self, df: DataFrame, names: Sequence[str], folder: str, id_col: str, ttl_seconds: float | None = None) -> DataFrame:
        """Computed values kept as Parquet by feature versions and input content; reused until ttl_seconds old."""
        from ..sources.versions import fingerprint

        spark = df.sparkSession
        key = hashlib.sha256(repr([(n, self.current(n).version, self.current(n).compute_hash) for n in self.order(names)] + [fingerprint(df)]).encode()).hexdigest()[:24]
        base = f"{folder}/{key}"
        manifest = self._newest(spark, base)
        now = datetime.now(timezone.utc).timestamp()
        if manifest is not None and (ttl_seconds is None or now - manifest <= ttl_seconds):
            return spark.read.parquet(f"{base}/{manifest!r}/data")
        self.compute(df.select(id_col, *(c for c in df.columns if c != id_col)), names).select(id_col, *names).write.parquet(f"{base}/{now!r}/data")
        return spark.read.parquet(f"{base}/{now!r}/data")

    @staticmethod
    def _newest(spark: SparkSession, base: str) -> float | None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return None
        done = [float(s.getPath().getName()) for s in fs.listStatus(hadoop) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "data/_SUCCESS"))]
        return max(done, default=None)


def standardised(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + 1e-6)


def array_mean(a: Column) -> Column:
    return total(a) / F.size(a)


def array_std(a: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    m = array_mean(a)
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(a) - 1)))
