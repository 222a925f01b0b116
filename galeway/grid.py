"""Georeferenced grids."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compass directions clockwise from southwest, with their row and column steps (rows count southwards).
DIRS = ("SW", "W", "NW", "N", "NE", "E", "SE", "S")
STEPS = ((1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0))


@dataclass(frozen=True)
class GridSpec:
    """Cells are numbered from 1, row by row from the northwest corner; longitudes and latitudes in degrees."""

    nrow: int
    ncol: int
    xmin: float
    xmax: float
    ymin: float
    ymax: float

    def __post_init__(self):
        if self.nrow < 1 or self.ncol < 1 or self.xmax <= self.xmin or self.ymax <= self.ymin:
            raise ValueError("a grid needs cells and an extent")

    @property
    def xres(self) -> float:
        return (self.xmax - self.xmin) / self.ncol

    @property
    def yres(self) -> float:
        return (self.ymax - self.ymin) / self.nrow

    @property
    def ncell(self) -> int:
        return self.nrow * self.ncol

    def check_lonlat(self) -> None:
        if self.xmin < -180 or self.xmax > 360 or self.ymin < -90 or self.ymax > 90:
            raise ValueError("a wind field needs longitudes in -180..360 and latitudes in -90..90")

    def x(self, col: Column) -> Column:
        return F.lit(self.xmin) + (col - 0.5) * F.lit(self.xres)

    def y(self, row: Column) -> Column:
        return F.lit(self.ymax) - (row - 0.5) * F.lit(self.yres)

    def latitude(self, row: int) -> float:
        return self.ymax - (row - 0.5) * self.yres

    def row_of(self, cell: Column) -> Column:
        return (F.floor((cell - 1) / self.ncol) + 1).cast("int")

    def col_of(self, cell: Column) -> Column:
        return ((cell - 1) % self.ncol + 1).cast("int")

    def cell(self, row: Column, col: Column) -> Column:
        return (row.cast("long") - 1) * self.ncol + col

    def with_coords(self, df: DataFrame) -> DataFrame:
        """df (cell) with row, col, x, y."""
        df = df.withColumns({"row": self.row_of(F.col("cell")), "col": self.col_of(F.col("cell"))})
        return df.withColumns({"x": self.x(F.col("col")), "y": self.y(F.col("row"))})

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.with_coords(spark.range(1, self.ncell + 1).withColumnRenamed("id", "cell"))

    def lookup(self, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """(cell, row, col) of points; points on the last edges belong to the last cells; null outside."""
        col = F.least(F.floor((x - self.xmin) / self.xres) + 1, F.lit(self.ncol))
        row = F.least(F.floor((F.lit(self.ymax) - y) / self.yres) + 1, F.lit(self.nrow))
        inside = x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax)
        row, col = F.when(inside, row).cast("int"), F.when(inside, col).cast("int")
        return self.cell(row, col), row, col

    def shift(self, dx: float = 0.0, dy: float = 0.0) -> GridSpec:
        return replace(self, xmin=self.xmin + dx, xmax=self.xmax + dx, ymin=self.ymin + dy, ymax=self.ymax + dy)

    def window(self, xmin: float, xmax: float, ymin: float, ymax: float) -> tuple[int, int, int, int]:
        """(first row, last row, first column, last column) of an extent, snapped to the nearest cell edges."""
        c0, c1 = round((xmin - self.xmin) / self.xres), round((xmax - self.xmin) / self.xres)
        r0, r1 = round((self.ymax - ymax) / self.yres), round((self.ymax - ymin) / self.yres)
        c0, r0 = min(max(c0, 0), self.ncol - 1), min(max(r0, 0), self.nrow - 1)
        return r0 + 1, max(r0 + 1, min(r1, self.nrow)), c0 + 1, max(c0 + 1, min(c1, self.ncol))

    def sub(self, r0: int, r1: int, c0: int, c1: int) -> GridSpec:
        return GridSpec(r1 - r0 + 1, c1 - c0 + 1, self.xmin + (c0 - 1) * self.xres, self.xmin + c1 * self.xres, self.ymax - r1 * self.yres, self.ymax - (r0 - 1) * self.yres)

    def crop(self, df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> tuple[DataFrame, GridSpec]:
        """Cells of an extent, numbered anew. The filter on row and col reaches the scan."""
        r0, r1, c0, c1 = self.window(xmin, xmax, ymin, ymax)
        new = self.sub(r0, r1, c0, c1)
        df = df.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
        df = df.withColumns({"row": (F.col("row") - (r0 - 1)).cast("int"), "col": (F.col("col") - (c0 - 1)).cast("int")})
        return df.withColumn("cell", new.cell(F.col("row"), F.col("col"))), new

    def fine(self, fact: int) -> GridSpec:
        return replace(self, nrow=self.nrow * fact, ncol=self.ncol * fact)


def tesselate(df: DataFrame, grid: GridSpec, width: float = 20.0) -> tuple[DataFrame, GridSpec]:
    """A global grid with copies of its margins, `width` degrees wide, on the other sides. Cells are numbered anew."""
    if not math.isclose(grid.xmax - grid.xmin, 360):
        raise ValueError("tesselate needs a global grid")
    n = round(width / grid.xres)
    new = replace(grid, ncol=grid.ncol + 2 * n, xmin=grid.xmin - n * grid.xres, xmax=grid.xmax + n * grid.xres)
    west = df.where(F.col("col") > grid.ncol - n).withColumn("col", F.col("col") - grid.ncol)
    east = df.where(F.col("col") <= n).withColumn("col", F.col("col") + grid.ncol)
    both = west.unionByName(df).unionByName(east).withColumn("col", (F.col("col") + n).cast("int"))
    return both.withColumns({"cell": new.cell(F.col("row"), F.col("col")), "x": new.x(F.col("col"))}), new


def merge(df: DataFrame, grid: GridSpec, other: DataFrame, other_grid: GridSpec, values: list[str]) -> tuple[DataFrame, GridSpec]:
    """Both grids on one that covers them, cells of which `df` has the values, or where those are null or absent, `other`.

    The grids must have one resolution and lie on the same cell edges. Each value is judged by itself.
    """
    xres, yres = grid.xres, grid.yres
    off = ((other_grid.xmin - grid.xmin) / xres, (other_grid.ymax - grid.ymax) / yres)
    if not (math.isclose(xres, other_grid.xres) and math.isclose(yres, other_grid.yres)) or any(abs(z - round(z)) > 1e-6 for z in off):
        raise ValueError("the grids don't line up")
    xmin, ymax = min(grid.xmin, other_grid.xmin), max(grid.ymax, other_grid.ymax)
    xmax, ymin = max(grid.xmax, other_grid.xmax), min(grid.ymin, other_grid.ymin)
    new = GridSpec(round((ymax - ymin) / yres), round((xmax - xmin) / xres), xmin, xmax, ymin, ymax)

    def placed(d: DataFrame, g: GridSpec, first: int) -> DataFrame:
        row, col = F.col("row") + round((ymax - g.ymax) / yres), F.col("col") + round((g.xmin - xmin) / xres)
        return d.select(new.cell(row, col).alias("cell"), F.struct(F.lit(first).alias("first"), *values).alias("v"))

    both = placed(df, grid, 0).unionByName(placed(other, other_grid, 1))
    pick = lambda c: F.min(F.when(F.col(f"v.{c}").isNotNull(), F.struct(F.col("v.first").alias("f"), F.col(f"v.{c}").alias("z"))))["z"].alias(c)
    return new.with_coords(both.groupBy("cell").agg(*map(pick, values))), new
