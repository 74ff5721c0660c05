"""Structured Streaming over the events table.

An extension: nothing of the kind is asked for elsewhere. All operators take a
streaming frame with ts, user_id, event_type and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than ``late`` are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events with no gap of ``gap``."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def first_of_each(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
