"""Shared pieces of the training-data operators: scratch tables in the cluster's shared folder and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUB_BATCH_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one is set only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


class Scratch:
    """Tables that cut lineage: written as Parquet to the shared folder and read again; they go when the driver's JVM ends, or sooner by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.top}/{self._n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        if self._n == 1:
            top = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
            top.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(top)
        again = self.spark.read.schema(df.schema).parquet(path)
        again._scratch_path = path
        return again

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def column_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with those of ``df``."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted += "_"
    return wanted


def text_sub_batches(batch: pa.RecordBatch, column: str = "text", size: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``size`` bytes of text each (a longer text stands alone)."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not batch.num_rows:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.cast(pa.large_string()).buffers()[1], np.int64)[: len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether a table has at most ``most`` rows (counted, so only for tables that are cheap to make)."""
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on, how: str, most: int) -> DataFrame:
    """Broadcasts ``right`` when it has at most ``most`` rows; otherwise a shuffle join that Spark may split by skew."""
    return left.join(F.broadcast(right) if small_enough(right, most) else right, on, how)


def crc_remainder(column: str, n: int):
    """crc32 of a column as text, modulo ``n`` (null counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
