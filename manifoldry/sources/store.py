"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors see: spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given.

    Without either, a local master, whose executors are this machine's threads, gets a temporary folder; on a cluster
    it is an error, since each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_kept: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes with all that was written there when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if path not in _kept:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _kept.add(path)
    return path


def settled(df: DataFrame, label: str = "table") -> DataFrame:
    """`df` written and read back: lineage ends here, values stay as they are, and a lost executor loses nothing."""
    path = f"{own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
