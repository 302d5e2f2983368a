import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallystream-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def keys(spark):
    """Rows with a `key` column: keys("a", 3) or keys({"a": 3, "b": 1})."""

    def make(counts, times=1):
        if isinstance(counts, str):
            counts = {counts: times}
        rows = spark.createDataFrame(list(counts.items()), "key string, n int")
        return rows.select("key", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select("key")

    return make


@pytest.fixture(scope="session")
def numbered(spark):
    """n rows with key prefix + (i mod distinct)."""

    def make(prefix, n, distinct=None):
        return spark.range(n).select(
            F.concat(F.lit(prefix), (F.col("id") % (distinct or n)).cast("string")).alias("key")
        )

    return make
