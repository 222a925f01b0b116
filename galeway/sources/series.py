"""Wind series and fields from tables, and a reader of gridded hourly winds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from galeway.grid import GridSpec
from galeway.operators.rose import Trans, WindRose, wind_rose
from galeway.sources.netcdf import NetCdf

SERIES = ("cell", "row", "col", "x", "y", "step", "u", "v")


@dataclass(frozen=True)
class WindSeries:
    """df(cell, row, col, x, y, step, u, v): one row for each cell and step."""

    df: DataFrame
    grid: GridSpec
    n_steps: int | None = None

    def __post_init__(self):
        if lost := set(SERIES) - set(self.df.columns):
            raise ValueError(f"a wind series needs the columns {sorted(lost)}")

    @classmethod
    def from_long(cls, df: DataFrame, grid: GridSpec) -> WindSeries:
        """df: cell, step, u, v."""
        return cls(grid.with_coords(df), grid)

    @classmethod
    def from_wide(cls, df: DataFrame, grid: GridSpec, order: str = "uuvv") -> WindSeries:
        """df: cell and an even number of layers, all u then all v, or (uvuv) in turns; position is the step, from 0."""
        if order not in ("uuvv", "uvuv"):
            raise ValueError("order must be uuvv or uvuv")
        layers = [c for c in df.columns if c not in ("cell", "row", "col", "x", "y")]
        if not layers or len(layers) % 2:
            raise ValueError("a wind series needs an even number of layers")
        n = len(layers) // 2
        us, vs = (layers[:n], layers[n:]) if order == "uuvv" else (layers[::2], layers[1::2])
        steps = F.array(*(F.struct(F.lit(i).alias("step"), F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")) for i, (a, b) in enumerate(zip(us, vs, strict=True))))
        return cls(grid.with_coords(df.select("cell", F.explode(steps).alias("s")).select("cell", "s.*")), grid, n)

    def rose(self, trans: Trans = 1, **options) -> WindRose:
        return wind_rose(self.df, self.grid, trans, n_steps=self.n_steps, **options)

    def stack(self, other: WindSeries) -> WindSeries:
        """The steps of both, those of `other` after those of this one, by their order."""
        if self.grid != other.grid:
            raise ValueError("the grids differ")
        after = self.df.agg((F.coalesce(F.max("step"), F.lit(-1)) + 1).alias("_after"))
        low = other.df.agg(F.min("step").alias("_low"))
        moved = other.df.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(low)).withColumn("step", F.col("step") - F.col("_low") + F.col("_after"))  # one row each
        both = None if None in (self.n_steps, other.n_steps) else self.n_steps + other.n_steps
        return WindSeries(self.df.select(*SERIES).unionByName(moved.select(*SERIES)), self.grid, both)

    def field(self, step: int) -> WindField:
        return WindField(self.df.where(F.col("step") == step), self.grid)


@dataclass(frozen=True)
class WindField:
    """A series of a single step, in longitudes and latitudes."""

    df: DataFrame
    grid: GridSpec

    def __post_init__(self):
        self.grid.check_lonlat()
        if lost := {"row", "col", "u", "v"} - set(self.df.columns):
            raise ValueError(f"a wind field needs the columns {sorted(lost)}")


class _Day(InputPartition):
    def __init__(self, year: int, month: int, day: int):
        super().__init__((year, month, day))


def _days(years: Iterable[int], months: Iterable[int], days: Iterable[int]) -> list[tuple[int, int, int]]:
    """Valid dates among all combinations."""
    import datetime

    if bad := [y for y in years if not 1979 <= y <= 2010]:
        raise ValueError(f"years must be between 1979 and 2010, not {bad}")
    if bad := [m for m in months if not 1 <= m <= 12]:
        raise ValueError(f"months must be between 1 and 12, not {bad}")
    if bad := [d for d in days if not 1 <= d <= 31]:
        raise ValueError(f"days must be between 1 and 31, not {bad}")
    out = []
    for y in years:
        for m in months:
            for d in days:
                try:
                    datetime.date(y, m, d)
                except ValueError:
                    continue
                out.append((y, m, d))
    return out


class ReanalysisSource(DataSource):
    """format("reanalysis"): hourly winds from archives <path>/<variable>/<yyyymmdd>.nc or .npz (lon, lat, hour, u, v) that all executors reach.

    One partition for each day, handed over as one Arrow batch; the options lon, lat and hour (low:high, inclusive) select the part
    of the arrays that is read. Filters are left to Spark: a reader that takes them keeps them for every later use of the same DataFrame. Rows: ts, hour, lon, lat, u, v; layer=land (land.nc or land.npz with soil): lon, lat, w.
    """

    @classmethod
    def name(cls) -> str:
        return "reanalysis"

    def schema(self) -> str:
        return "lon double, lat double, w double" if self.options.get("layer") == "land" else "ts timestamp, hour int, lon double, lat double, u double, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.box = {"lon": [0.0, 360.0], "lat": [-90.0, 90.0], "hour": [0.0, 23.0]}
        for k in self.box:
            if k in options:
                low, high = map(float, options[k].split(":"))
                self.box[k] = [max(self.box[k][0], low), min(self.box[k][1], high)]

    def partitions(self) -> list[InputPartition]:
        if self.o.get("layer") == "land":
            return [InputPartition("land")]
        nums = lambda k, d: [int(x) for x in self.o.get(k, d).split(",")]
        return [_Day(*d) for d in _days(nums("years", "1979"), nums("months", "1"), nums("days", "1"))]

    def _array(self, partition: InputPartition) -> dict:
        """Coordinates and values inside the box; a .nc file is read by the rows of its slab alone, an .npz file whole."""
        import os

        import numpy as np

        o, land = self.o, self.o.get("layer") == "land"
        y, m, d = (0, 0, 0) if land else partition.value
        base = f"{o['path']}/land" if land else f"{o['path']}/{o.get('variable', 'wnd10m')}/{y:04d}{m:02d}{d:02d}"
        names, values = (["lat", "lon"], ["soil"]) if land else (["hour", "lat", "lon"], ["u", "v"])
        if os.path.exists(f"{base}.nc"):
            held = NetCdf(f"{base}.nc")
            axes = {k: held.read(k) for k in names}
        else:
            with np.load(f"{base}.npz") as f:
                held = {k: f[k] for k in names + values}
            axes = {k: held[k] for k in names}
        at = [np.flatnonzero((axes[k] >= self.box[k][0]) & (axes[k] <= self.box[k][1])) for k in names]
        out = {k: axes[k][i] for k, i in zip(names, at, strict=True)}
        return out | {k: held.read(k, at) if isinstance(held, NetCdf) else held[k][np.ix_(*at)] for k in values}

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import numpy as np

        a = self._array(partition)
        names = [k for k in ("hour", "lat", "lon") if k in a]
        z = {k: g.ravel() for k, g in zip(names, np.meshgrid(*(a[k] for k in names), indexing="ij"), strict=True)}
        lon, lat = (pa.array(z[k].astype(float)) for k in ("lon", "lat"))
        if self.o.get("layer") == "land":
            yield pa.RecordBatch.from_arrays([lon, lat, pa.array(np.isfinite(a["soil"]).ravel().astype(float))], ["lon", "lat", "w"])
            return
        y, m, d = partition.value
        ts = np.datetime64(f"{y:04d}-{m:02d}-{d:02d}T00", "us") + z["hour"].astype("timedelta64[h]")
        yield pa.RecordBatch.from_arrays(
            [pa.array(ts, pa.timestamp("us", "UTC")), pa.array(z["hour"].astype(np.int32)), lon, lat, *(pa.array(a[k].ravel().astype(float)) for k in ("u", "v"))],
            ["ts", "hour", "lon", "lat", "u", "v"],
        )


def read_reanalysis(spark: SparkSession, path: str, variable: str = "wnd10m", years: Iterable[int] = (1979,), months: Iterable[int] = (1,), days: Iterable[int] = (1,),
                    hlim: tuple[int, int] = (0, 23), xlim: tuple[float, float] = (260, 270), ylim: tuple[float, float] = (40, 50)) -> DataFrame:
    """ts, hour, lon, lat, u, v of all combinations of years, months and days that are dates; bounds are inclusive."""
    _days(years, months, days)
    if min(xlim) < 0 or max(xlim) > 360 or min(ylim) < -90 or max(ylim) > 90:
        raise ValueError("longitudes must be between 0 and 360, latitudes between -90 and 90")
    spark.dataSource.register(ReanalysisSource)
    join = lambda xs: ",".join(map(str, xs))
    reader = spark.read.format("reanalysis").options(path=path, variable=variable, years=join(years), months=join(months), days=join(days))
    return reader.options(hour=f"{min(hlim)}:{max(hlim)}", lon=f"{min(xlim)}:{max(xlim)}", lat=f"{min(ylim)}:{max(ylim)}").load()


def read_land_mask(spark: SparkSession, path: str, xlim: tuple[float, float] = (260, 270), ylim: tuple[float, float] = (40, 50)) -> DataFrame:
    """lon, lat, w: 1 on land (soil has a finite temperature there), else 0."""
    spark.dataSource.register(ReanalysisSource)
    return spark.read.format("reanalysis").options(path=path, layer="land", lon=f"{min(xlim)}:{max(xlim)}", lat=f"{min(ylim)}:{max(ylim)}").load()


def gridded(df: DataFrame, order: str = "ts") -> WindSeries:
    """A series from ts, lon, lat, u, v: the grid follows the coordinates that occur, steps follow `order`."""
    e = df.agg(F.min("lon"), F.max("lon"), F.countDistinct("lon"), F.min("lat"), F.max("lat"), F.countDistinct("lat")).first()
    xres, yres = ((e[i + 1] - e[i]) / max(1, e[i + 2] - 1) or 1.0 for i in (0, 3))
    grid = GridSpec(e[5], e[2], e[0] - xres / 2, e[1] + xres / 2, e[3] - yres / 2, e[4] + yres / 2)
    cell, _, _ = grid.lookup(F.col("lon"), F.col("lat"))
    steps = df.select(order).distinct().withColumn("step", F.row_number().over(Window.orderBy(order)) - 1)  # a row for each hour: some 280,000 in 32 years
    return WindSeries.from_long(df.join(steps, order).select(cell.alias("cell"), "step", order, "u", "v"), grid)
