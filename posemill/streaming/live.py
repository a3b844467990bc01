"""Hopping-window statistics and class mix over a stream of measured frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_windows(frames: DataFrame, key: str, time: str, value: str, size: str = "3 seconds", step: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """key, start, end, n, mean, deviation and valid share of each window. Frames later than `late` are ignored; state is
    kept for open windows only. Medians need all rows of a window, so a stream gives means."""
    windows = frames.withWatermark(time, late).groupBy(key, F.window(time, size, step))
    out = windows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.avg(F.col(value).isNotNull().cast("double")).alias("valid"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "deviation", "valid")
