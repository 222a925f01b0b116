"""A reader of GeoTIFF rasters: layers by cell, block by block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.grid import GridSpec

#: Sizes and codes of field types; tags by number, as the format fixes them.
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 277: "layers", 278: "strip_rows", 279: "strip_sizes", 284: "planar", 317: "predictor",
    322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_sizes", 339: "kind", 33550: "scale", 33922: "tie", 42113: "nodata",
}


class GeoTiff:
    """Uncompressed or deflated rasters without rotation, classic or BigTIFF, in strips or tiles."""

    def __init__(self, raw: bytes):
        self.raw, o = raw, {b"II": "<", b"MM": ">"}.get(raw[:2])
        if o is None or (version := struct.unpack_from(o + "H", raw, 2)[0]) not in (42, 43):
            raise ValueError("no TIFF file")
        big = version == 43
        at = struct.unpack_from(o + ("Q" if big else "I"), raw, 8 if big else 4)[0]
        n = struct.unpack_from(o + ("Q" if big else "H"), raw, at)[0]
        self.order, t = o, {"layers": (1,), "planar": (1,), "compression": (1,), "predictor": (1,), "kind": (1,)}
        for k in range(n):
            e = at + (8 if big else 2) + k * (20 if big else 12)
            tag, kind, count = struct.unpack_from(o + ("HHQ" if big else "HHI"), raw, e)
            if tag in _TAGS:
                form = o + _FIELDS[kind] * count
                inline, size = e + (12 if big else 8), struct.calcsize(form)
                where = inline if size <= (8 if big else 4) else struct.unpack_from(o + ("Q" if big else "I"), raw, inline)[0]
                t[_TAGS[tag]] = struct.unpack_from(form, raw, where)
        if t["compression"][0] not in (1, 8, 32946) or t["predictor"][0] not in (1, 2):
            raise ValueError("only uncompressed and deflated rasters are supported")
        self.t, self.nrow, self.ncol, self.n_layers = t, t["height"][0], t["width"][0], t["layers"][0]
        self.dtype = np.dtype(o + {1: "u", 2: "i", 3: "f"}[t["kind"][0]] + str(t["bits"][0] // 8))
        xres, yres = t["scale"][:2]
        x, y = t["tie"][3] - t["tie"][0] * xres, t["tie"][4] + t["tie"][1] * yres
        self.grid = GridSpec(self.nrow, self.ncol, x, x + self.ncol * xres, y - self.nrow * yres, y)
        self.nodata = float(b"".join(t["nodata"]).rstrip(b"\0 ")) if "nodata" in t else None

    def blocks(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(layer, first row, first column, values) by strip or tile; layer is -1 where a block has all layers as its last axis."""
        t, tiled = self.t, "tiles" in self.t
        h, w = (t["tile_height"][0], t["tile_width"][0]) if tiled else (min(self.nrow, t.get("strip_rows", (self.nrow,))[0]), self.ncol)
        per = 1 if t["planar"][0] == 2 else self.n_layers
        across, down = -(-self.ncol // w), -(-self.nrow // h)
        for k, (at, size) in enumerate(zip(t["tiles" if tiled else "strips"], t["tile_sizes" if tiled else "strip_sizes"], strict=True)):
            layer, place = divmod(k, across * down)
            row, col = place // across * h, place % across * w
            raw = self.raw[at : at + size]
            rows = h if tiled else min(h, self.nrow - row)
            values = np.frombuffer(raw if t["compression"][0] == 1 else zlib.decompress(raw), self.dtype, rows * w * per).reshape(rows, w, per)
            if t["predictor"][0] == 2:
                values = np.cumsum(values, 1, dtype=self.dtype.newbyteorder("="))
            values = values[: self.nrow - row, : self.ncol - col].astype(float)
            if self.nodata is not None:
                values = np.where(values == self.nodata, np.nan, values)
            yield (layer if per == 1 else -1), row, col, values


def read_grid(spark: SparkSession, path: str) -> GridSpec:
    """The grid of a raster."""
    return GeoTiff(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])).grid


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """path, cell, row, col, layer (from 1), value of one or more rasters; gaps are null. A task holds one file and gives one block after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                tiff = GeoTiff(bytes(raw))
                for layer, row, col, z in tiff.blocks():
                    r, c, k = np.indices(z.shape)
                    out = pd.DataFrame({"path": name, "row": (row + r + 1).ravel(), "col": (col + c + 1).ravel(), "layer": (k if layer < 0 else k + layer).ravel() + 1, "value": z.ravel()})
                    yield out.assign(cell=(out.row - 1) * tiff.ncol + out.col)[["path", "cell", "row", "col", "layer", "value"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, cell long, row int, col int, layer int, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def wide(layers: DataFrame, n_layers: int) -> DataFrame:
    """cell, l1, l2, ...: a column for each layer, as series of layers take them."""
    return layers.groupBy("cell").agg(*(F.max(F.when(F.col("layer") == k, F.col("value"))).alias(f"l{k}") for k in range(1, n_layers + 1)))
