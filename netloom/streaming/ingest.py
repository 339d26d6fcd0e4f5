"""Edge streams: windowed tensor slices with watermarks, and event transitions kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_tensor(edges: DataFrame, sender: str, receiver: str, value: str, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tensor slices of tumbling windows; edges later than `late` after the newest seen are dropped by the watermark."""
    w = F.window(time, width)
    rows = edges.withWatermark(time, late) if edges.isStreaming else edges
    return rows.groupBy(w.alias("w"), F.col(sender).alias("i"), F.col(receiver).alias("j")).agg(F.sum(value).alias("y")).select(F.col("w.start").alias("t"), "i", "j", "y")


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by day and type."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")
