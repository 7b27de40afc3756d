"""Observation counts over a stream: an extension, since the batch operator only sees finished tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_observations(stream: DataFrame, time: str, group: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, group, seen, nulls, zeros, mean, min_value, max_value) per window; rows later than the watermark are dropped by Spark."""
    v = F.col(value).cast("double")
    found = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.count("*").alias("seen"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count_if(v == 0).alias("zeros"), F.avg(v).alias("mean"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))
    return found.select(F.col("window.start").alias("window_start"), group, "seen", "nulls", "zeros", "mean", "min_value", "max_value")
