"""Structured Streaming over event tables: watermarked windows and recurring commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def read_events(spark: SparkSession, path: str, schema: T.StructType, time: str = "ts") -> DataFrame:
    """Files of a folder as a stream, with the event time as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, every: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count, sum and mean of value by tumbling window and keys; rows later than `late` drop out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, every), *keys)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Session windows: events of a key that follow within `gap`."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append finished windows to a Parquet table; the checkpoint makes restarts exact."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
