"""Circular statistics and summaries of accessibility surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.functions import geo
from galeway.grid import GridSpec


def circular(b: Column, w: Column, compat: bool = False) -> tuple[Column, Column]:
    """(bearing, isotropy) as aggregates of bearings in degrees with weights; null or NaN bearings are left out.

    isotropy: sqrt(1 - length of the mean vector), 0 to 1. compat takes the bearing of the mean vector as
    if it were a point in degrees on the ellipsoid.
    """
    ok = b.isNotNull() & ~F.isnan(b) & w.isNotNull()
    total = F.sum(F.when(ok, w))
    x, y = F.sum(F.when(ok, w * F.sin(F.radians(b)))) / total, F.sum(F.when(ok, w * F.cos(F.radians(b)))) / total
    iso = F.sqrt(F.greatest(F.lit(0.0), 1 - F.sqrt(x * x + y * y)))
    if compat:
        return F.struct(x.alias("x"), y.alias("y")), iso
    return F.degrees(F.atan2(x, y)), iso


def circ_sd(df: DataFrame, bearing: str, weight: str | None = None, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """by, bearing, iso."""
    b, iso = circular(F.col(bearing), F.col(weight) if weight else F.lit(1.0), compat)
    out = df.groupBy(*by).agg(b.alias("bearing"), iso.alias("iso"))
    if compat:
        zero = F.lit(0.0)
        out = out.withColumn("bearing", geo.geodesic(zero, zero, F.col("bearing.x"), F.col("bearing.y"))["azimuth"])
    return out


def ws_summarize(surface: DataFrame, grid: GridSpec, origin: tuple[float, float], radius: float | None = None, round_bearings: bool = True) -> DataFrame:
    """One row: centroid_x, _y, _distance, _bearing, windshed_distance, _bearing, _isotropy, _size, _landarea.

    surface: cell, row, col, x, y, z. Cells weigh by their width at their latitude; those in the origin's
    row by how far they lie outside a cell around it; cells with no finite z, or radius km away or
    more, are left out. One pass with one aggregate; the width by row is a small table.
    """
    ox, oy = origin
    half = grid.xres / 2
    width = lambda lat: geo.np_inverse(-half, lat, half, lat)[0] / 1000
    widths = [(r, float(width(grid.latitude(r)))) for r in range(1, grid.nrow + 1)]
    d0, dy = float(width(0.0)) / 2, float(width(oy)) / 2
    df = surface.join(F.broadcast(surface.sparkSession.createDataFrame(widths, "row int, weight double")), "row")
    z = F.col("z")
    df = df.where(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")))
    df = df.withColumn("g", geo.geodesic(F.lit(ox), F.lit(oy), F.col("x"), F.col("y")))
    if radius is not None:
        df = df.where(F.col("g.km") < radius)
    bi, bo = d0 - dy, d0 + dy
    out = (F.abs(F.col("x") - ox) * dy / (grid.yres / 2) - bi) / (bo - bi)
    w = F.when(F.abs(F.col("y") - oy) < grid.yres / 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))).otherwise(1.0)
    brng = F.bround(F.col("g.azimuth")) if round_bearings else F.col("g.azimuth")
    df = df.select("x", "y", "z", (F.col("weight") * w).alias("w"), F.col("g.km").alias("km"), brng.alias("b")).withColumn("zw", F.col("z") * F.col("w"))
    mean = lambda v, by: F.sum(F.col(v) * F.col(by)) / F.sum(by)
    bearing, iso = circular(F.col("b"), F.col("zw"))
    one = df.agg(
        mean("x", "zw").alias("centroid_x"), mean("y", "zw").alias("centroid_y"), mean("km", "zw").alias("windshed_distance"), bearing.alias("windshed_bearing"),
        iso.alias("windshed_isotropy"), mean("z", "w").alias("windshed_size"), F.sum(F.when(F.col("z") > 0, F.col("w")).otherwise(0.0)).alias("windshed_landarea"),
    )
    one = one.withColumn("c", geo.geodesic(F.lit(ox), F.lit(oy), F.col("centroid_x"), F.col("centroid_y")))
    return one.select("centroid_x", "centroid_y", F.col("c.km").alias("centroid_distance"), F.col("c.azimuth").alias("centroid_bearing"), "windshed_distance", "windshed_bearing", "windshed_isotropy", "windshed_size", "windshed_landarea")
