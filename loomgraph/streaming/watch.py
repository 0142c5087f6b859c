"""Following changes of files and of event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def interval_seconds(files: int) -> int:
    """Five seconds, and one more for each 500 files, up to a minute."""
    return min(60, 5 + files // 500)


def watch(spark: SparkSession, folder: str, refresh: Callable[[DataFrame, int], None], checkpoint: str, files: int = 0, once: bool = False):
    """Calls refresh with the files (path, mtime, size, content) of each batch that are new in folder."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    writer = stream.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content").writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{interval_seconds(files)} seconds").start()


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each kind by time window; works on tables and on streams, where late rows go."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
