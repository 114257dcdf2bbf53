"""Written intermediate tables, for results that several branches of a job read.

The tables go to the shared folder named by ``spark.checkpoint.dir``, so they survive lost executors and
cut the lineage. A session on one machine may leave the setting out; on a cluster this is an error,
because executors cannot see each other's local folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch(spark: SparkSession) -> str:
    """Path of a new folder in the shared location."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back as columns."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no later read needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
