"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FOLDER = "tallystream"


def scratch_root(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, which all executors share.

    Where it is unset, a local session (one machine, as in tests) gets a temporary folder; on a cluster that
    would be local to a machine, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallystream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet below the shared folder and reads it back.

    Cuts the lineage: what is read survives the loss of any executor, and costly columns are computed once.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{FOLDER}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def drop_staged(df: DataFrame) -> None:
    """Deletes the folders of a staged table that is no longer read."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{FOLDER}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
