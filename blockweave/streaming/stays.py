"""An extension: stays and block sizes as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(points: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a driver's points (driver_id, ts): runs without a longer gap. A gap between two is a stay."""
    s = points.withWatermark("ts", late).groupBy("driver_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("driver_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cell_counts(points: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Points of each cell in each window of time (cell_x, cell_y, ts)."""
    s = points.withWatermark("ts", late).groupBy("cell_x", "cell_y", F.window("ts", window)).agg(F.count("*").alias("n"))
    return s.select("cell_x", "cell_y", F.col("window.start").alias("start"), "n")
