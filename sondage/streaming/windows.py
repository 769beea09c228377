"""Streaming twins: sessions by gap, tumbling and sliding windows with watermarks; the batch operators are authoritative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(files: DataFrame, by: str, time: str, gap: str, late: str) -> DataFrame:
    """Per node: session window, number of files; a session is emitted when the watermark has passed it."""
    return files.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("files"), F.min(time).alias("first"), F.max(time).alias("last"))


def tumbling(samples: DataFrame, by: str, time: str, value: str, length: str, late: str) -> DataFrame:
    """Per node and window: deviation, root mean square and number of samples."""
    w = F.window(time, length).alias("w")
    return samples.withWatermark(time, late).groupBy(by, w).agg(F.stddev_pop(value).alias("std"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(value).alias("n"))


def sliding(samples: DataFrame, by: str, time: str, value: str, length: str, step: str, late: str) -> DataFrame:
    w = F.window(time, length, step).alias("w")
    return samples.withWatermark(time, late).groupBy(by, w).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(value).alias("n"))


def station_levels(readings: DataFrame, station: str, time: str, value: str, late: str) -> DataFrame:
    """Running mean, deviation and count of each station and day."""
    return readings.withWatermark(time, late).groupBy(station, F.window(time, "1 day").alias("day")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
