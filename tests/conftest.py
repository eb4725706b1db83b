import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    return session


@pytest.fixture
def events(spark):
    """make(values by key and milliseconds): a table (event_id, ts, key, value)."""

    def make(rows):
        data = [(i, float(t), k, float(v)) for i, (k, t, v) in enumerate(rows)]
        return spark.createDataFrame(data, "event_id long, ms double, key string, value double").selectExpr("event_id", "timestamp_micros(cast(ms * 1000 as bigint)) AS ts", "key", "value")

    return make
