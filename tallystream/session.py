"""Session defaults and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings the operators profit from; every operator gives the same rows without them.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # plans are built from many small expressions; do not record a Python stack for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tallystream", **conf: str) -> SparkSession:
    """A session with the recommended settings; `master` and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stream_state_dir(spark: SparkSession, name: str) -> str:
    """Where a streaming query keeps its checkpoint: below the cluster's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass checkpoint=...")
    return f"{root.rstrip('/')}/{name}"
