"""Wind roses: per-cell conductance in eight directions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.functions import geo
from galeway.grid import DIRS, GridSpec

Trans = float | int | Callable[[Column], Column]
#: Positions of DIRS among the sectors, which run clockwise from north.
SECTOR = {"N": 0, "NE": 1, "E": 2, "SE": 3, "S": 4, "SW": 5, "W": 6, "NW": 7}


def weigh(trans: Trans) -> Callable[[Column], Column]:
    """A number is an exponent of speed (0: direction only, 1: speed, 2: drag, 3: force); a function maps a Column."""
    if callable(trans):
        return trans
    if trans < 0:
        raise ValueError("trans must not be negative")
    return lambda s: F.pow(s, F.lit(float(trans)))


def neighbour_geometry(grid: GridSpec, true_res: bool = False) -> list[tuple]:
    """By row: bearings of the NE and SE neighbours, metres to N, NE, E, SE, S. Latitudes are clamped to the poles.

    All depends on the latitude only, so it is worked out once for each row, not each cell.
    """
    dx, dy = (grid.xres, grid.yres) if true_res else ((grid.xres + grid.yres) / 2,) * 2
    lat = np.array([grid.latitude(r) for r in range(1, grid.nrow + 1)])
    up, down = np.minimum(lat + dy, 90), np.maximum(lat - dy, -90)
    ne, se = geo.np_rhumb(0, lat, dx, up), geo.np_rhumb(0, lat, dx, down)
    d = [geo.np_inverse(0, lat, x, y)[0] for x, y in ((0, up), (dx, up), (dx, lat), (dx, down), (0, down))]
    return [(r + 1, float(ne[r]), float(se[r]), *(float(k[r]) for k in d)) for r in range(grid.nrow)]


GEOMETRY = "row int, b_ne double, b_se double, d_n double, d_ne double, d_e double, d_se double, d_s double"


def sector(theta: Column) -> Column:
    """struct(k, f): the sector that a bearing lies in, and how far towards the next bound; a bearing on a bound belongs before it."""
    bounds = [F.lit(0.0), F.col("b_ne"), F.lit(90.0), F.col("b_se"), F.lit(180.0), 360 - F.col("b_se"), F.lit(270.0), 360 - F.col("b_ne"), F.lit(360.0)]
    out = None
    for k in range(8):
        s = F.struct(F.lit(k).alias("k"), ((theta - bounds[k]) / (bounds[k + 1] - bounds[k])).alias("f"))
        out = F.when(theta <= bounds[k + 1], s) if out is None else out.when(theta <= bounds[k + 1], s)
    return out


def loadings(series: DataFrame, grid: GridSpec, trans: Trans = 1, by: tuple[str, ...] = ("cell", "row", "col", "x", "y"), skip_null: bool = False, true_res: bool = False) -> DataFrame:
    """by, n_obs, SW..S: sums of weights dealt to the two neighbours whose bearings enclose the wind's.

    Partial sums are formed before the one shuffle on the cell. A null u or v is left out and not
    counted (skip_null), or makes the cell's loadings null.
    """
    spark = series.sparkSession
    rows = spark.createDataFrame(neighbour_geometry(grid, true_res), GEOMETRY)  # one small row for each latitude
    df = series.where("u is not null and v is not null") if skip_null else series
    df = df.join(F.broadcast(rows), "row").withColumn("_w", weigh(trans)(geo.speed(F.col("u"), F.col("v"))))
    df = df.withColumn("_s", sector(geo.bearing_to(F.col("u"), F.col("v"))))
    k, f, w = F.col("_s.k"), F.col("_s.f"), F.col("_w")
    load = {d: F.sum(F.when(k == i, (1 - f) * w).when(k == (i - 1) % 8, f * w).otherwise(0.0)) for d, i in SECTOR.items()}
    whole = F.count("*") == F.count("_s")
    return df.groupBy(*by).agg(F.count("*").alias("n_obs"), *(F.when(whole, load[d]).alias(d) for d in DIRS))


def conductance(load: DataFrame, grid: GridSpec, true_res: bool = False) -> DataFrame:
    """Loadings -> per hour: times 3600 s, by metres to the neighbour and number of steps."""
    rows = load.sparkSession.createDataFrame(neighbour_geometry(grid, true_res), GEOMETRY)
    metres = {"SW": "d_se", "W": "d_e", "NW": "d_ne", "N": "d_n", "NE": "d_ne", "E": "d_e", "SE": "d_se", "S": "d_s"}
    df = load.join(F.broadcast(rows), "row")
    return df.withColumns({d: F.col(d) * 3600 / F.col(m) / F.col("n_obs") for d, m in metres.items()}).drop("n_obs", *(c.split()[0] for c in GEOMETRY.split(", ")[1:]))


@dataclass(frozen=True)
class WindRose:
    """df(cell, row, col, x, y, SW, W, NW, N, NE, E, SE, S) on a grid."""

    df: DataFrame
    grid: GridSpec
    trans: Trans = 1
    n_steps: int | None = None
    columns: tuple = field(default=("cell", "row", "col", "x", "y", *DIRS), repr=False)

    def __post_init__(self):
        if lost := set(self.columns) - set(self.df.columns):
            raise ValueError(f"a wind rose needs the columns {sorted(lost)}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, grid: GridSpec, trans: Trans = 1, n_steps: int | None = None) -> WindRose:
        return cls(spark.read.parquet(path), grid, trans, n_steps)

    def write(self, path: str, **options) -> None:
        self.df.write.options(**options).parquet(path)

    def long(self) -> DataFrame:
        """cell, k (position in DIRS), c."""
        pairs = F.array(*(F.struct(F.lit(i).alias("k"), F.col(d).alias("c")) for i, d in enumerate(DIRS)))
        return self.df.select("cell", "row", "col", F.explode(pairs).alias("p")).select("cell", "row", "col", "p.k", "p.c")

    def total(self) -> Column:
        return sum((F.col(d) for d in DIRS[1:]), F.col(DIRS[0]))

    def weight(self, weights: DataFrame) -> WindRose:
        """All directions times a weight by cell (cell, w); a cell without one gets null."""
        df = self.df.join(weights.select("cell", F.col("w").alias("_weight")), "cell", "left").withColumns({d: F.col(d) * F.col("_weight") for d in DIRS}).drop("_weight")
        return WindRose(df, self.grid, self.trans, self.n_steps)

    def downscale(self, fact: int, method: str = "bilinear") -> WindRose:
        """fact x fact cells for each one, conductances times fact."""
        df, grid = disaggregate(self.df, self.grid, fact, list(DIRS), method)
        return WindRose(df.withColumns({d: F.col(d) * fact for d in DIRS}), grid, self.trans, self.n_steps)

    def crop(self, xmin: float, xmax: float, ymin: float, ymax: float) -> WindRose:
        df, grid = self.grid.crop(self.df, xmin, xmax, ymin, ymax)
        return WindRose(df, grid, self.trans, self.n_steps)

    def geo_correction(self) -> None:
        raise TypeError("a wind rose is already corrected for distances between cells")


def wind_rose(series: DataFrame, grid: GridSpec, trans: Trans = 1, skip_null: bool = False, true_res: bool = False, n_steps: int | None = None) -> WindRose:
    df = conductance(loadings(series, grid, trans, skip_null=skip_null, true_res=true_res), grid, true_res)
    return WindRose(df, grid, trans, n_steps)


windrose_rasters = wind_rose


def disaggregate(df: DataFrame, grid: GridSpec, fact: int, values: list[str], method: str = "bilinear") -> tuple[DataFrame, GridSpec]:
    """Finer cells by nearest or bilinear sampling; corners beyond the grid are clamped, null or absent corners give null."""
    if not isinstance(fact, int) or fact < 1:
        raise ValueError("fact must be a single positive integer")
    if method not in ("near", "bilinear"):
        raise ValueError("method must be near or bilinear")
    fine = grid.fine(fact)
    steps = F.sequence(F.lit(1), F.lit(fact))
    base = df.select("row", "col", *values).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    base = base.withColumns({"frow": (F.col("row") - 1) * fact + F.col("i"), "fcol": (F.col("col") - 1) * fact + F.col("j")})
    if method == "near":
        out = base.select("frow", "fcol", *values)
    else:
        at = base.select("frow", "fcol", ((F.col("frow") - 0.5) / fact + 0.5).alias("ry"), ((F.col("fcol") - 0.5) / fact + 0.5).alias("cx"))
        out = bilinear(at, df, grid, "cx", "ry", ["frow", "fcol"], values)
    out = out.withColumnsRenamed({"frow": "row", "fcol": "col"}).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})
    out = out.withColumns({"cell": fine.cell(F.col("row"), F.col("col")), "x": fine.x(F.col("col")), "y": fine.y(F.col("row"))})
    return out.select("cell", "row", "col", "x", "y", *values), fine


def bilinear(points: DataFrame, df: DataFrame, grid: GridSpec, cx: str, ry: str, keys: list[str], values: list[str]) -> DataFrame:
    """keys and values interpolated at fractional (column, row) positions: an equi-join with four corners, and a weighted sum."""
    r0, c0 = F.floor(ry), F.floor(cx)
    corners = F.array(*(
        F.struct(
            F.greatest(F.lit(1), F.least(F.lit(grid.nrow), r0 + i)).cast("int").alias("row"), F.greatest(F.lit(1), F.least(F.lit(grid.ncol), c0 + j)).cast("int").alias("col"),
            ((F.col(ry) - r0 if i else r0 + 1 - F.col(ry)) * (F.col(cx) - c0 if j else c0 + 1 - F.col(cx))).alias("_share"),
        ) for i in (0, 1) for j in (0, 1)
    ))
    four = points.select(*keys, F.explode(corners).alias("_corner")).select(*keys, "_corner.*").where("_share > 0")
    near = four.join(df.select("row", "col", *values), ["row", "col"], "left")
    return near.groupBy(*keys).agg(*(F.when(F.count(v) == F.count("*"), F.sum(F.col("_share") * F.col(v))).alias(v) for v in values))


def sample(points: DataFrame, df: DataFrame, grid: GridSpec, keys: list[str], values: list[str]) -> DataFrame:
    """values at points (x, y): bilinear, clamped in the outer half cells, null outside the extent."""
    inside = F.col("x").between(grid.xmin, grid.xmax) & F.col("y").between(grid.ymin, grid.ymax)
    at = points.where(inside).select(*keys, ((F.col("x") - grid.xmin) / grid.xres + 0.5).alias("_cx"), ((F.lit(grid.ymax) - F.col("y")) / grid.yres + 0.5).alias("_ry"))
    return points.join(bilinear(at, df, grid, "_cx", "_ry", keys, values), keys, "left")
