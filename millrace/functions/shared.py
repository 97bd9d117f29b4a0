"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Where it is unset, a folder
    of this machine if Spark runs in one process, else one in the home directory
    of a default file system that is not a local disk."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if _local(spark):
        return tempfile.mkdtemp(prefix="millrace-")
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        raise RuntimeError("spark.checkpoint.dir is not set, and the default file system is one machine's")
    return f"{fs.getHomeDirectory().toString()}/.millrace"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is there goes when the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed, so that their lineage ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, as Parquet files: a fraction of the disk of a checkpoint."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
