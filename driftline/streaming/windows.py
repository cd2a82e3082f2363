"""The same windowed aggregates over a static or a streaming measurement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "100 milliseconds", delay: str = "1 day") -> DataFrame:
    """Count and newest time per sensor and window; in a stream, state older than `delay` goes.

    delay bounds how late a file of events may come; later rows are dropped.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return (
        timed.groupBy(F.col("event_type").alias("sensor"), F.window("at", width).alias("w"))
        .agg(F.count("*").alias("n"), F.max("at").alias("newest"))
        .select("sensor", F.unix_micros("w.start").alias("window_us"), "n", F.unix_micros("newest").alias("last_us"))
    )


def voxel_stream(events: DataFrame, leaf: float = 10.0, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Mean value per sensor, day and voxel of value, over a static or streaming table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return (
        timed.groupBy(F.col("event_type").alias("sensor"), F.window("at", width).alias("w"), F.floor(F.col("value") / leaf).alias("cell"))
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        .select("sensor", F.unix_micros("w.start").alias("window_us"), "cell", "n", "mean")
    )
