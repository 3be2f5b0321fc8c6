"""Continuous ingestion: new record files are read as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.text import dedup_key, is_blank, sha256
from lexmill.sources.schema import RECORD


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Records of JSON-lines files as they appear in a folder, with the time of arrival; blank texts are left out."""
    d = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return d.where(~is_blank(F.col("text"))).withColumn("ingested_at", F.current_timestamp())


def first_seen(stream: DataFrame, within: str = "1 day", time: str = "ingested_at") -> DataFrame:
    """The first record of each text (case and blanks ignored) within a time; older keys leave the state."""
    return stream.withColumn("text_key", sha256(dedup_key(F.col("text")))).withWatermark(time, within).dropDuplicatesWithinWatermark(["text_key"])


def append_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
