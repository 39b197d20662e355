"""Streaming over events: an extension, the reference has none. The same
functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def tumbling(events: DataFrame, *, at: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, *, at: str, by: str, width: str = "6 hours", step: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, *, at: str, by: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    s = e.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, *, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once; in a stream, keys are remembered as long as the watermark
    lets their like still come."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
