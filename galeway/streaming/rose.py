"""Roses of a stream: loadings are sums, so they can be kept by cell and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeway.grid import GridSpec
from galeway.operators.rose import Trans, conductance, loadings

KEYS = ("cell", "row", "col", "x", "y")


def windowed(series: DataFrame, grid: GridSpec, window: str = "1 day", watermark: str = "1 hour", trans: Trans = 1) -> DataFrame:
    """start and a rose of each cell and window of ts; batch and stream alike. Late rows are dropped after the watermark (streams only)."""
    df = series.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", watermark) if series.isStreaming else df
    load = loadings(df.withColumn("_window", F.window("ts", window)), grid, trans, by=("_window", *KEYS))
    return conductance(load, grid).withColumn("start", F.col("_window.start")).drop("_window")


def running(loads: DataFrame, new: DataFrame) -> DataFrame:
    """Loadings (cell, n_obs, directions) plus those of another batch."""
    from galeway.grid import DIRS

    return loads.unionByName(new).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_obs", *DIRS)))
