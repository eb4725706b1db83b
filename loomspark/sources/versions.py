"""Dataset versions on plain Parquet: snapshots, keyed deltas, branches, diffs and merges.

A store is a folder with one data folder per version and manifest files. One writer; data is written first, then a new
manifest; readers take the highest manifest. Only the manifest, one row per version, comes to the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import is_close


def _hashes(df: DataFrame) -> list[Column]:
    h = F.xxhash64(*df.columns)
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("total"), F.bit_xor(F.xxhash64(F.lit(7), *df.columns)).alias("mix")]


def fingerprint(df: DataFrame) -> str:
    """sha256, 12 digits, of schema and content; the order of rows does not matter. One pre-aggregated pass."""
    row = df.agg(*_hashes(df)).first()
    schema = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return hashlib.sha256(json.dumps([schema, row.n, row.total, row.mix]).encode()).hexdigest()[:12]


def content_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, total, mix): a fingerprint that other engines can make, too. Of each row's md5 over its columns, joined
    by | without nulls, the sum of the first 48 bits and the exclusive or of the next. The order of rows does not matter."""
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(part(1).cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(part(13)).alias("mix"))


def statistics(df: DataFrame, key: str) -> DataFrame:
    """(column, mean, std, min, max, norm) of each numeric column but the key; no rows if there is none."""
    rows = []
    for f in df.schema.fields:
        if f.name != key and isinstance(f.dataType, T.NumericType):
            c = F.col(f.name).cast("double")
            rows.append(F.struct(F.lit(f.name).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.sqrt(F.sum(c * c)).alias("norm")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, mean double, std double, min double, max double, norm double")
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _sides(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full join of rows named a and b by key, a null key being a key like others. a._here and b._here are null where a
    side has no row."""
    a, b = (df.withColumn("_here", F.lit(True)).alias(n) for df, n in ((old, "a"), (new, "b")))
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")


def _columns(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def _same(f: T.StructField, a: Column, b: Column) -> Column:
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return (a.isNull() & b.isNull()) | F.coalesce(is_close(a, b), F.lit(False))
    return a.eqNullSafe(b)


def changed_cells(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, column, old, new) as strings for every cell that differs, rows on one side only included. One full join."""
    fields = [f for f in old.schema.fields if f.name != key]
    cells = []
    for f in fields:
        x, y = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        cells.append(F.when(~_same(f, x, y), F.struct(F.lit(f.name).alias("column"), x.cast("string").alias("old"), y.cast("string").alias("new"))))
    return _sides(old, new, key).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array_compact(F.array(*cells))).alias("c")).select(key, "c.*")


def stats_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(column, stat, old, new, change): statistics of both, a missing one counting as 0."""

    def long(df: DataFrame, side: str) -> DataFrame:
        return statistics(df, key).unpivot(["column"], ["mean", "std", "min", "max", "norm"], "stat", side)

    j = long(old, "old").join(long(new, "new"), ["column", "stat"], "full").na.fill(0.0, ["old", "new"])
    return j.withColumn("change", F.col("new") - F.col("old"))


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that are new or differ, with _deleted false, and keys that went, with _deleted true.

    A null key is a key like others. Keys must be unique in each table; VersionStore refuses tables where they are not.
    """
    differ = reduce(lambda x, y: x | y, (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _columns(new, key)), F.lit(False))
    gone = F.col("b._here").isNull()
    j = _sides(old, new, key).filter(F.col("a._here").isNull() | gone | differ)
    return j.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(F.col(f"b.{c}").alias(c) for c in _columns(new, key)), gone.alias("_deleted"))


def apply_deltas(base: DataFrame, deltas: list[DataFrame], key: str) -> DataFrame:
    """The base with deltas applied in order: a union, and the latest row per key. One shuffle for the whole chain."""
    every = [base.withColumn("_deleted", F.lit(False)), *deltas]
    union = reduce(DataFrame.unionByName, (d.withColumn("_depth", F.lit(i)) for i, d in enumerate(every)))
    row = F.struct("_depth", "_deleted", *_columns(base, key))
    last = union.groupBy(key).agg(F.max_by(row, "_depth").alias("r"))
    return last.filter("NOT r._deleted").select(*(F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in base.columns))


def merged(ours: DataFrame, theirs: DataFrame, key: str, how: str) -> DataFrame:
    """theirs, ours, or the mean of numeric cells (other cells from ours). Schemas and keys must be the same for mean."""
    if how in ("ours", "theirs"):
        return ours if how == "ours" else theirs
    if how != "mean":
        raise ValueError(f"unknown merge {how}")
    if ours.schema != theirs.schema:
        raise ValueError("schemas differ")
    j = _sides(ours, theirs, key)
    if j.filter(F.col("a._here").isNull() | F.col("b._here").isNull()).limit(1).count():
        raise ValueError("keys differ")
    out = []
    for f in ours.schema.fields:
        x, y = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        number = isinstance(f.dataType, T.NumericType) and f.name != key
        out.append((((x + y) / 2).cast(f.dataType) if number else x).alias(f.name))
    return j.select(*out)


@dataclass
class Version:
    id: str
    parent: str | None
    branch: str
    at: str
    message: str
    metadata: dict
    content: str
    full: bool
    rows: int
    schema: str
    statistics: list = field(default_factory=list)
    folder: str = ""


class VersionStore:
    """Commits, branches, merges and retention over one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, max_versions: int | None = None, deduplicate: bool = True, delta_share: float = 0.1):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.max_versions, self.deduplicate, self.delta_share = max_versions, deduplicate, delta_share
        self.versions: dict[str, Version] = {}
        self.branches: dict[str, str | None] = {"main": None}
        self.branch, self.number = "main", 0
        self._read()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self) -> None:
        fs, p = self._fs(f"{self.folder}/manifest")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])] if fs.exists(p) else []
        if numbers:
            self.number = max(numbers)
            data = json.loads(self.spark.read.text(f"{self.folder}/manifest/{self.number}", wholetext=True).filter("length(value) > 0").first()[0])
            self.versions = {v["id"]: Version(**v) for v in data["versions"]}
            self.branches, self.branch = data["branches"], data["branch"]

    def _write(self) -> None:
        self.number += 1
        text = json.dumps({"versions": [asdict(v) for v in self.versions.values()], "branches": self.branches, "branch": self.branch})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/{self.number}")

    def commit(self, df: DataFrame, message: str = "", metadata: dict | None = None) -> str:
        """The version's id. Known content, if deduplicated, keeps its id; the branch's head moves in any case."""
        if df.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"keys in {self.key} are not unique")
        content, parent = fingerprint(df), self.branches[self.branch]
        vid = content if self.deduplicate else hashlib.sha256(f"{content}{parent}{self.number}".encode()).hexdigest()[:12]
        if vid not in self.versions:
            rows, full = df.count(), True
            if parent and self.versions[parent].schema == df.schema.json():
                change = delta(self.load(parent), df, self.key)
                if change.count() < self.delta_share * max(rows, 1):
                    change.write.mode("overwrite").parquet(f"{self.folder}/data/{vid}")
                    full = False
            if full:
                df.write.mode("overwrite").parquet(f"{self.folder}/data/{vid}")
            stats = [r.asDict() for r in statistics(df, self.key).collect()]  # a row per column
            self.versions[vid] = Version(vid, parent, self.branch, datetime.now(timezone.utc).isoformat(), message, metadata or {}, content, full, rows, df.schema.json(), stats, vid)
        self.branches[self.branch] = vid
        unused = self._retain()
        self._write()
        for folder in unused:  # only after no manifest that readers take names them
            fs, p = self._fs(f"{self.folder}/data/{folder}")
            fs.delete(p, True)
        return vid

    def lineage(self, version: str) -> list[str]:
        """The version and its ancestors, newest first."""
        out, at = [], version
        while at in self.versions:
            out.append(at)
            at = self.versions[at].parent
        return out

    def load(self, version: str | None = None) -> DataFrame:
        version = version or self.branches[self.branch]
        if version not in self.versions:
            raise ValueError(f"unknown version {version}")
        chain = []
        for v in self.lineage(version):
            chain.append(v)
            if self.versions[v].full:
                break
        read = [self.spark.read.parquet(f"{self.folder}/data/{self.versions[v].folder or v}") for v in reversed(chain)]
        return read[0] if len(read) == 1 else apply_deltas(read[0], read[1:], self.key)

    def create_branch(self, name: str, version: str | None = None) -> None:
        if name in self.branches:
            raise ValueError(f"branch {name} exists")
        self.branches[name] = version or self.branches[self.branch]
        self._write()

    def checkout(self, name: str) -> DataFrame:
        """A branch, which becomes the current one, or a version."""
        if name in self.branches:
            self.branch = name
            self._write()
        elif name not in self.versions:
            raise ValueError(f"unknown branch or version {name}")
        return self.load(self.branches.get(name, name))

    def diff(self, old: str, new: str, cells: int = 100) -> tuple[DataFrame, DataFrame, dict]:
        """(changed cells, at most `cells` by key and column; statistics; summary)."""
        a, b = self.load(old), self.load(new)
        changes = stats_diff(a, b, self.key)
        va, vb = self.versions[old], self.versions[new]
        summary = {"schema_changed": va.schema != vb.schema, "rows_changed": va.rows != vb.rows, "stats_over_0.1": changes.filter("abs(change) > 0.1").count()}
        return changed_cells(a, b, self.key).orderBy(self.key, "column").limit(cells), changes, summary

    def merge(self, source: str, how: str, message: str = "") -> str:
        ours, theirs = self.branches[self.branch], self.branches[source]
        out = merged(self.load(ours), self.load(theirs), self.key, how)
        return self.commit(out, message, {"merge": how, "ours": ours, "theirs": theirs})

    def _retain(self) -> list[str]:
        """The oldest versions go, heads never; deltas that need one become snapshots, in folders of their own, first.
        Gives the data folders that are no longer used."""
        unused: list[str] = []
        heads = set(self.branches.values())
        for v in sorted(self.versions.values(), key=lambda v: v.at) if self.max_versions is not None else ():
            if len(self.versions) <= self.max_versions:
                break
            if v.id in heads:
                continue
            for child in [c for c in self.versions.values() if c.parent == v.id]:
                if not child.full:
                    snapshot = f"{child.id}-{self.number + 1}"
                    self.load(child.id).write.mode("overwrite").parquet(f"{self.folder}/data/{snapshot}")
                    unused.append(child.folder or child.id)
                    child.full, child.folder = True, snapshot
                child.parent = v.parent
            del self.versions[v.id]
            unused.append(v.folder or v.id)
        return unused

    def statistics(self) -> DataFrame:
        full = sum(v.full for v in self.versions.values())
        return self.spark.createDataFrame([(len(self.versions), full, len(self.versions) - full, len(self.branches))], "versions long, snapshots long, deltas long, branches long")
