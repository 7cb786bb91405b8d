"""Streams of values: windowed summaries and histograms with a watermark for late rows (an extension of the batch forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, time: str, value: str, by: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation and extremes per group and window; state is dropped once the watermark has passed a window."""
    window = F.window(time, every).alias("w")
    return stream.withWatermark(time, late).groupBy(by, window).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("vmin"), F.max(value).alias("vmax")).select(by, F.col("w.start").alias("start"), "n", "mean", "sd", "vmin", "vmax")


def windowed_histogram(stream: DataFrame, time: str, value: str, width: float, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per bin of `width` and window; the bins that occur are the state."""
    window = F.window(time, every).alias("w")
    return stream.withWatermark(time, late).groupBy(window, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")
