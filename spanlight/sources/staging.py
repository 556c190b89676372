"""Intermediate tables in the folder that driver and executors share; they cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the context's. One of our own only where neither is set and
    all tasks run in this process; on a cluster that is an error, as executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, base: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{base}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")


def removed(spark: SparkSession, base: str, *names: str) -> None:
    """Frees written tables that no later step reads."""
    jvm = spark._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
