"""Particle trails through a single wind field, and samplers of starting points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.functions import geo
from galeway.grid import GridSpec
from galeway.operators.rose import sample
from galeway.plans.iterate import cut

#: A field up to this number of cells is broadcast to the kernels (16 bytes a cell); beyond it, steps are joins.
FIELD_CELLS = 4_000_000
DIRECTIONS = {"downwind": 1, "upwind": -1}


def grid_shape(grid: GridSpec, n: int) -> tuple[int, int]:
    """(columns, rows) of about n points with the extent's aspect."""
    ar = (grid.ymax - grid.ymin) / (grid.xmax - grid.xmin)
    return max(1, round((n / ar) ** 0.5)), max(1, round(ar * (n / ar) ** 0.5))


def geo_grid(spark: SparkSession, grid: GridSpec, n: int) -> DataFrame:
    """p, x, y: a regular grid of about n points, west to east first, from the south."""
    nx, ny = grid_shape(grid, n)
    dx, dy = (grid.xmax - grid.xmin) / nx, (grid.ymax - grid.ymin) / ny
    p = F.col("id")
    return spark.range(nx * ny).select((p + 1).alias("p"), (F.lit(grid.xmin) + (p % nx + 0.5) * dx).alias("x"), (F.lit(grid.ymin) + (F.floor(p / nx) + 0.5) * dy).alias("y"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise."""
    pts = sorted(map(tuple, points))

    def chain(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def uniform(seed: int, key: str) -> Column:
    """A number in 0..1 by row id: the first 52 bits of md5(seed:key:id), so the same whatever task works it out."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{key}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def generate_particles(spark: SparkSession, grid: GridSpec, n: int = 1000, sample: str = "random", equalarea: bool = True, epsg: int = 8857, expand: float = 0.25, seed: int = 1) -> DataFrame:
    """p, x, y. random: n points, uniform in degrees or (equalarea) on the sphere, latitudes by the inverse of their area;
    grid: regular in degrees, or in the Equal Earth projection inside the hull of the domain."""
    if sample not in ("random", "grid"):
        raise ValueError("sample must be random or grid")
    if sample == "grid" and not equalarea:
        return geo_grid(spark, grid, n)
    if sample == "random":
        u = uniform(seed, "y")
        s0, s1 = np.sin(np.radians([grid.ymin, grid.ymax]))
        y = F.degrees(F.asin(F.lit(float(s0)) + u * float(s1 - s0))) if equalarea else F.lit(grid.ymin) + u * (grid.ymax - grid.ymin)
        return spark.range(n).select((F.col("id") + 1).alias("p"), (F.lit(grid.xmin) + uniform(seed, "x") * (grid.xmax - grid.xmin)).alias("x"), y.alias("y"))
    if epsg != 8857:
        raise ValueError("only the Equal Earth projection (8857) is supported")
    # the hull is that of the outermost of n regular points; it has as many as their grid has around its edge
    nx, ny = grid_shape(grid, n)
    lon, lat = grid.xmin + (np.arange(nx) + 0.5) * (grid.xmax - grid.xmin) / nx, grid.ymin + (np.arange(ny) + 0.5) * (grid.ymax - grid.ymin) / ny
    edge = [np.concatenate([lon, lon, np.full(ny, lon[0]), np.full(ny, lon[-1])]), np.concatenate([np.full(nx, lat[0]), np.full(nx, lat[-1]), lat, lat])]
    pts = np.unique(np.stack(geo.np_equal_earth(*edge), 1), axis=0)
    hull, (lo, hi) = _hull(pts), (pts.min(0), pts.max(0))
    pad = (hi - lo) * expand / 2
    box = GridSpec(1, 1, float(lo[0] - pad[0]), float(hi[0] + pad[0]), float(lo[1] - pad[1]), float(hi[1] + pad[1]))
    mx, _ = shape = grid_shape(box, n)
    points = spark.range(shape[0] * shape[1]).select("id", (F.lit(box.xmin) + (F.col("id") % mx + 0.5) * ((box.xmax - box.xmin) / mx)).alias("u"), (F.lit(box.ymin) + (F.floor(F.col("id") / mx) + 0.5) * ((box.ymax - box.ymin) / shape[1])).alias("v"))
    sides = F.array(*(F.array(*(F.lit(float(z)) for z in (*a, *b))) for a, b in zip(hull, np.roll(hull, -1, 0), strict=True)))
    inside = F.forall(sides, lambda s: (s[2] - s[0]) * (F.col("v") - s[1]) >= (s[3] - s[1]) * (F.col("u") - s[0]))
    x, y = geo.equal_earth_inverse(F.col("u"), F.col("v"))
    return points.where(inside).select((F.col("id") + 1).alias("p"), x.alias("x"), y.alias("y"))


def np_bilinear(u: np.ndarray, v: np.ndarray, grid: GridSpec, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both components at points: corners clamped to the grid, NaN outside the extent."""
    cx, ry = (x - grid.xmin) / grid.xres - 0.5, (grid.ymax - y) / grid.yres - 0.5
    ok = (x >= grid.xmin) & (x <= grid.xmax) & (y >= grid.ymin) & (y <= grid.ymax)
    cx, ry = np.where(ok, cx, 0), np.where(ok, ry, 0)
    c0, r0 = np.floor(cx).astype(int), np.floor(ry).astype(int)
    wx, wy = cx - c0, ry - r0
    out = []
    ca, cb = np.clip(c0, 0, grid.ncol - 1), np.clip(c0 + 1, 0, grid.ncol - 1)
    ra, rb = np.clip(r0, 0, grid.nrow - 1), np.clip(r0 + 1, 0, grid.nrow - 1)
    for f in (u, v):
        z = (1 - wy) * ((1 - wx) * f[ra, ca] + wx * f[ra, cb]) + wy * ((1 - wx) * f[rb, ca] + wx * f[rb, cb])
        out.append(np.where(ok, z, np.nan))
    return out[0], out[1]


def _step(u, v, s: int, scale: float, ignore_speed: bool, metric: str, lat):
    dx, dy = u * s, v * s
    if ignore_speed:
        sp = np.hypot(u, v)
        with np.errstate(invalid="ignore", divide="ignore"):
            dx, dy = dx / sp, dy / sp
        if metric == "compat":
            dx, dy = dx * scale, dy * scale
    dx = dx / geo.np_aspect(dy) if metric == "compat" else dx * geo.np_aspect(lat)
    return dx * scale, dy * scale


def particle_flow(field: DataFrame, grid: GridSpec, particles: DataFrame | int, n_iter: int = 100, scale: float = 0.01, wrap: str = "neither",
                  direction: str | Iterable[str] = "both", ignore_speed: bool = False, metric: str = "compat") -> DataFrame:
    """p, x, y, v, g, t: positions of particles (p, x, y) at steps t, which are negative upwind, with the speed there.

    field: row, col, u, v. A trail ends where it leaves the domain, unless it is wrapped around; g counts the
    passes in thousandths over p. metric "compat" divides the eastward step by the aspect of the
    northward one and, with ignore_speed, scales twice; "true" multiplies by the aspect at the latitude.
    """
    if wrap not in ("neither", "horizontal", "vertical", "both") or metric not in ("compat", "true"):
        raise ValueError("wrap must be neither, horizontal, vertical or both; metric compat or true")
    names = list(DIRECTIONS) if direction == "both" else [direction] if isinstance(direction, str) else list(direction)
    if not names or set(names) - set(DIRECTIONS):
        raise ValueError("direction must be downwind, upwind or both")
    grid.check_lonlat()
    spark = field.sparkSession
    if isinstance(particles, int):
        particles = generate_particles(spark, grid, particles)
    if grid.ncell > FIELD_CELLS:
        return relational_flow(field, grid, particles, n_iter, scale, names, wrap, ignore_speed, metric)
    cells = field.select("row", "col", "u", "v").toPandas()  # FIELD_CELLS rows at most
    u, v = np.full((grid.nrow, grid.ncol), np.nan), np.full((grid.nrow, grid.ncol), np.nan)
    u[cells.row - 1, cells.col - 1], v[cells.row - 1, cells.col - 1] = cells.u, cells.v
    held = spark.sparkContext.broadcast((u, v))
    xr, yr = grid.xmax - grid.xmin, grid.ymax - grid.ymin

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uu, vv = held.value
        for pdf in batches:
            for name in names:
                s, x, y, g = DIRECTIONS[name], pdf.x.to_numpy(float), pdf.y.to_numpy(float), np.zeros(len(pdf))
                for i in range(n_iter + 1):
                    pu, pv = np_bilinear(uu, vv, grid, x, y)
                    ok = ~np.isnan(pu) & ~np.isnan(pv)
                    if not (i == 0 and name == "upwind" and "downwind" in names):  # both directions start alike
                        yield pd.DataFrame({"p": pdf.p[ok], "x": x[ok], "y": y[ok], "v": np.hypot(pu, pv)[ok], "g": pdf.p[ok] + g[ok] / 1000, "t": i * s})
                    dx, dy = _step(pu, pv, s, scale, ignore_speed, metric, y)
                    x, y = x + dx, y + dy
                    if i < n_iter:
                        if wrap in ("horizontal", "both"):
                            a, b = x < grid.xmin, x > grid.xmax
                            x, g = x + xr * a - xr * b, g + s * (a | b)
                        if wrap in ("vertical", "both"):
                            a, b = y < grid.ymin, y > grid.ymax
                            y, g = y + yr * a - yr * b, g + s * (a | b)

    return particles.mapInPandas(run, "p long, x double, y double, v double, g double, t int")


def relational_flow(field: DataFrame, grid: GridSpec, particles: DataFrame, n_iter: int, scale: float, names: Iterable[str], wrap: str = "neither",
                    ignore_speed: bool = False, metric: str = "compat") -> DataFrame:
    """particle_flow() by joins with the field, for fields that no task should hold."""
    out, names = None, list(names)
    for name in names:
        s, at = DIRECTIONS[name], particles.select("p", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0).alias("passes"))
        for i in range(n_iter + 1):
            found = sample(at, field, grid, ["p", "passes"], ["u", "v"])
            here = cut(found.where("u is not null and v is not null and not isnan(u) and not isnan(v)"))
            if not (i == 0 and name == "upwind" and "downwind" in names):
                rec = here.select("p", "x", "y", geo.speed(F.col("u"), F.col("v")).alias("v"), (F.col("p") + F.col("passes") / 1000).alias("g"), F.lit(i * s).alias("t"))
                out = rec if out is None else out.unionByName(rec)
            dx, dy = F.col("u") * s, F.col("v") * s
            if ignore_speed:
                sp = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
                dx, dy = (F.when(sp > 0, d / sp * (scale if metric == "compat" else 1.0)) for d in (dx, dy))  # calm ends a trail
            dx = dx / geo.aspect(dy) if metric == "compat" else dx * geo.aspect(F.col("y"))
            at = here.select("p", (F.col("x") + dx * scale).alias("x"), (F.col("y") + dy * scale).alias("y"), "passes")
            for c, lo, hi, way in (("x", grid.xmin, grid.xmax, "horizontal"), ("y", grid.ymin, grid.ymax, "vertical")):
                if wrap in (way, "both"):
                    turn = F.when(F.col(c) < lo, 1).when(F.col(c) > hi, -1).otherwise(0)
                    at = at.withColumns({c: F.col(c) + turn * (hi - lo), "passes": F.col("passes") + s * F.abs(turn)})
    return out


def trails_to_wkt(trails: DataFrame) -> DataFrame:
    """p, wkt: a LINESTRING M of each particle in the order of t, which is M; a POINT M for a single position."""
    v = F.sort_array(F.collect_list(F.struct("t", "x", "y")))
    lines = trails.groupBy("p").agg(v.alias("v"))
    text = F.array_join(F.transform("v", lambda s: F.concat_ws(" ", s["x"].cast("string"), s["y"].cast("string"), s["t"].cast("string"))), ", ")
    return lines.select("p", F.concat(F.when(F.size("v") > 1, F.lit("LINESTRING M (")).otherwise("POINT M ("), text, F.lit(")")).alias("wkt"))
