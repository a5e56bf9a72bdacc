"""Incremental pages and events with Structured Streaming: file source, checkpoint, durable file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_pages(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """X1, X2. New Parquet files of a folder as a stream, at most so many a trigger."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """S17, X1. Append each batch once to a Parquet folder; all that is there now, or for good with a trigger interval."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Extension, beyond the reference: counts per key in event-time windows, late rows dropped after the watermark."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys)
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Extension, beyond the reference: sessions of each key that end after a gap."""
    windowed = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
