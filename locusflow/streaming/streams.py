"""Append-only files as streams: the same scans and transforms, resumed from the checkpoint's offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import training_log


def sequence_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """One sequence a line, from files as they appear."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "seq")


def log_events(spark: SparkSession, path: str) -> DataFrame:
    return training_log(spark.readStream.text(path))


def to_parquet(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Processes all that is new and stops; a restart goes on where the checkpoint ends, without repeating or losing files."""
    df = transform(stream) if transform else stream
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
