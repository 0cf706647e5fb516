"""The folder of checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the cluster's shared one (``spark.checkpoint.dir``), or a local one where none is named and the master is local."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, shared by driver and executors; it goes when the driver's JVM ends."""
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path
