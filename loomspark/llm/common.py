"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table whose row count was just measured is sent to every executor.
BROADCAST_ROWS = 200_000
#: White space of the word and line rules: space and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or the context's own checkpoint folder. Only a local
    session, as in tests, may have neither."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again. This cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made from them has been written."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in (f for f in folders if "/loomspark/" in f):
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df itself. df should be a staged table: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key counts as hot with over a thousandth of the rows, and at least this many.
HOT_ROWS = 10_000


def join_sized(left: DataFrame, right: DataFrame, key: str | list[str], size: str, rows: int) -> DataFrame:
    """Inner join on `key` (one or more columns), of which right has one row each, with its rows in left as `size`; left has `rows` rows.

    Hot keys, at most a thousand as the sizes add up to `rows`, are broadcast and leave left's rows where they are; the
    others are shuffled.
    """
    keys, bound = [key] if isinstance(key, str) else key, max(HOT_ROWS, rows // 1000)
    hot, cold = F.broadcast(right.filter(F.col(size) > bound)), right.filter(F.col(size) <= bound)
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(cold, key))


def bounded_batches(spark: SparkSession, size: str = "2m") -> None:
    """From now on Arrow batches of this session have about `size` bytes at most, else 10,000 rows of whole texts, which
    an executor holds twice for each task: in its JVM and in the Python worker. Rows and results stay the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _give_back() -> None:
    """Return what freed objects leave unused to the system: a worker waits for its next task for up to a minute."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes, so that what a task makes of a batch is bounded too."""
    for batch in batches:
        rows = max(1, int(size * batch.num_rows // max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    batch = None
    _give_back()


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
