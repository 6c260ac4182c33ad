"""Streams of frames and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_frames(stream: DataFrame, key: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once, as it first arrives; keys are remembered until the watermark has passed them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_stats(stream: DataFrame, time: str, group: str, value: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """start, group, n, mean, low, high of tumbling windows; late rows count until the watermark has passed."""
    late = stream.withWatermark(time, delay) if stream.isStreaming else stream
    out = late.groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), group, "n", "mean", "low", "high")
