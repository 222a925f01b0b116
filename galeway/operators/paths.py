"""Least-cost paths: travel-time surfaces, pairwise distances, and local refinement of close pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.functions import geo
from galeway.grid import DIRS, STEPS, GridSpec
from galeway.operators.distance import cell_distance, kilometres, point_distance
from galeway.operators.graph import wind_graph
from galeway.operators.rose import WindRose
from galeway.plans.iterate import cut, discard

#: Graphs up to this number of edges are broadcast to the kernels (20 bytes an edge); larger ones are relaxed by joins.
KERNEL_EDGES = 4_000_000


class Graph:
    """Edges in rows of their origin: those of node v are to[first[v] : first[v + 1]], with their costs. Nodes are numbered from 0."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, cost: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.first, self.to, self.cost = np.searchsorted(src[order], np.arange(n + 1)), dst[order].astype(np.int32), cost[order]
        self.step = float(cost.mean()) if len(cost) else 1.0

    def least(self, starts: list[int] | np.ndarray) -> np.ndarray:
        """Least costs from any of starts to all nodes, infinite where there is no path.

        Nodes that got nearer wait; those within a step of the nearest one are settled together, again if need be.
        """
        d = np.full(len(self.first) - 1, np.inf)
        d[starts] = 0.0
        waiting = np.unique(starts)
        while len(waiting):
            near = d[waiting] <= d[waiting].min() + self.step
            now = waiting[near]
            size = self.first[now + 1] - self.first[now]
            e = np.repeat(self.first[now + 1] - np.cumsum(size), size) + np.arange(size.sum())
            to, new = self.to[e], np.repeat(d[now], size) + self.cost[e]
            better = new < d[to]
            np.minimum.at(d, to[better], new[better])
            waiting = np.unique(np.concatenate([waiting[~near], to[better]]))
        return d


def _kernel(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cell, d) by one search for each source. The edges, whose number is checked, are broadcast; sources are dealt to as many tasks as there are cores."""
    spark = edges.sparkSession
    e = edges.select("src", "dst", "cost").toPandas()
    nodes = np.unique(np.concatenate([e.src, e.dst])).astype(np.int64)
    held = spark.sparkContext.broadcast((nodes, Graph(len(nodes), np.searchsorted(nodes, e.src), np.searchsorted(nodes, e.dst), e.cost.to_numpy(float))))
    each = sources.groupBy("source").agg(F.collect_set("cell").alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, graph = held.value
        for pdf in batches:
            for source, cells in zip(pdf.source, pdf.cells, strict=True):
                cells = np.asarray(cells, np.int64)
                at = np.minimum(np.searchsorted(nodes, cells), max(0, len(nodes) - 1))
                known = nodes[at] == cells if len(nodes) else np.zeros(len(cells), bool)
                d = graph.least(at[known])
                ok = np.isfinite(d)
                alone = cells[~known]  # starts without edges reach themselves
                yield pd.DataFrame({"source": source, "cell": np.concatenate([nodes[ok], alone]), "d": np.concatenate([d[ok], np.zeros(len(alone))])})

    return each.repartition(spark.sparkContext.defaultParallelism, "source").mapInPandas(run, "source long, cell long, d double")


def _relational(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(source, cell, d) by rounds of joins in which only the nearest of the cells that got nearer are joined with the edges.

    As in Graph.least(): those within a mean edge of the nearest one go first, so that few are settled twice. A round's table replaces the last one's.
    """
    edges = cut(edges.select("src", "dst", "cost"))
    step = edges.agg(F.avg("cost")).first()[0] or 1.0
    known = cut(sources.select("source", "cell", F.lit(0.0).alias("d"), F.lit(True).alias("new")))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        nearest = known.where("new").agg(F.min("d")).first()[0]
        if nearest is None:
            break
        now = F.col("new") & (F.col("d") <= nearest + step)
        reached = known.where(now).join(edges, F.col("cell") == F.col("src")).groupBy("source", F.col("dst").alias("cell")).agg(F.min(F.col("d") + F.col("cost")).alias("r"))
        both = known.select("source", "cell", "d", (F.col("new") & ~now).alias("waits")).join(reached, ["source", "cell"], "full")
        near = F.col("r").isNotNull() & (F.col("d").isNull() | (F.col("r") < F.col("d")))
        old, known = known, cut(both.select("source", "cell", F.when(near, F.col("r")).otherwise(F.col("d")).alias("d"), (near | F.coalesce("waits", F.lit(False))).alias("new")))
        discard(old)
        rounds += 1
    return known.select("source", "cell", "d")


def accumulate(edges: DataFrame, sources: DataFrame, strategy: str = "auto") -> DataFrame:
    """Least cost from each source (source, cell; several cells make one source) to every cell it reaches."""
    if strategy == "auto":
        strategy = "kernel" if edges.count() <= KERNEL_EDGES else "relational"
    return _kernel(edges, sources) if strategy == "kernel" else _relational(edges, sources)


def _rate(d: Column, rate: bool) -> Column:
    return F.when(d == 0, F.lit(float("inf"))).otherwise(1 / F.when(d == 0, F.lit(None)).otherwise(d)) if rate else d


def least_cost_surface(edges: DataFrame, grid: GridSpec, sites: DataFrame, rate: bool = False, strategy: str = "auto") -> DataFrame:
    """cell, row, col, x, y, z: cost from the nearest of the sites (x, y); cells that none reaches are infinite (rate: 0)."""
    cell, _, _ = grid.lookup(F.col("x"), F.col("y"))
    starts = sites.select(F.lit(0).cast("long").alias("source"), cell.alias("cell")).where("cell is not null").distinct()
    d = accumulate(edges, starts, strategy).select("cell", "d")
    nodes = edges.select(F.col("src").alias("cell")).union(edges.select(F.col("dst").alias("cell"))).distinct()
    z = nodes.join(d, "cell", "full").withColumn("d", F.coalesce("d", F.lit(float("inf"))))
    return grid.with_coords(z.withColumn("z", _rate(F.col("d"), rate))).select("cell", "row", "col", "x", "y", "z")


def least_cost_distance(edges: DataFrame, grid: GridSpec, sites: DataFrame, adjust: bool = True, rate: bool = False, strategy: str = "auto") -> DataFrame:
    """i, j, value: cost from site i to site j (site, x, y). adjust: times point by cell distance; null in the diagonal and within a cell."""
    cell, _, _ = grid.lookup(F.col("x"), F.col("y"))
    _, row, col = grid.lookup(F.col("x"), F.col("y"))
    at = sites.select("site", "x", "y", cell.alias("cell"), grid.x(col).alias("cx"), grid.y(row).alias("cy"))
    starts = at.where("cell is not null").select(F.col("cell").alias("source"), "cell").distinct()
    d = accumulate(edges, starts, strategy)
    pairs = at.toDF("i", "x1", "y1", "ci", "cx1", "cy1").crossJoin(at.toDF("j", "x2", "y2", "cj", "cx2", "cy2"))  # the matrix of sites is the result
    out = pairs.join(d, (F.col("ci") == F.col("source")) & (F.col("cj") == F.col("cell")), "left").withColumn("value", F.coalesce("d", F.lit(float("inf"))))
    if adjust:
        p, c = kilometres("x1", "y1", "x2", "y2"), kilometres("cx1", "cy1", "cx2", "cy2")
        out = out.select("i", "j", "value", p.alias("p"), c.alias("c"))
        out = out.withColumn("value", F.when(F.col("c") > 0, F.col("value") * F.col("p") / F.when(F.col("c") > 0, F.col("c"))))
    out = out.select("i", "j", "value")
    return out.withColumn("value", _rate(F.col("value"), rate))


def _edges_of(rose: np.ndarray, upwind: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a dense rose (row, col, direction)."""
    nr, nc, _ = rose.shape
    ids = np.arange(nr * nc).reshape(nr, nc)
    src, dst, cost = [], [], []
    for k, (dr, dc) in enumerate(STEPS):
        kk = (k + 4) % 8 if upwind else k
        a = (slice(max(0, -dr), nr - max(0, dr)), slice(max(0, -dc), nc - max(0, dc)))
        b = (slice(max(0, dr), nr - max(0, -dr)), slice(max(0, dc), nc - max(0, -dc)))
        c = (rose[a][..., kk] + rose[b][..., kk]) / 2
        ok = c > 0
        src.append(ids[a][ok])
        dst.append(ids[b][ok])
        cost.append(1 / c[ok])
    return np.concatenate(src), np.concatenate(dst), np.concatenate(cost)


def refine(rose: np.ndarray, fact: int, method: str) -> np.ndarray:
    """A dense rose on fact x fact finer cells, times fact."""
    if method == "near":
        return rose.repeat(fact, 0).repeat(fact, 1) * fact
    out = rose
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(n * fact) + 0.5) / fact - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), n - 1)
        hi = np.minimum(lo + 1, n - 1)
        w = (at - lo).reshape([-1 if a == axis else 1 for a in range(3)])
        out = np.take(out, lo, axis) * (1 - w) + np.take(out, hi, axis) * w
    return out * fact


def vrcd(rose: WindRose, sites: DataFrame, threshold_km: float = 30, pad: float = 1, max_nodes: float = 1e6, direction: str = "downwind", method: str = "bilinear") -> DataFrame:
    """i, j, wind_dist, wind_dist_coarse, point_dist, cell_dist, cell_dist_coarse (not adjusted).

    Costs between sites no more than threshold_km apart are worked out anew on a window around each
    pair, refined as far as max_nodes cells allow: one group for each pair, which holds only its window.
    """
    grid = rose.grid
    coarse = least_cost_distance(wind_graph(rose, direction), grid, sites, adjust=False).withColumnRenamed("value", "wind_dist_coarse")
    points, cells = point_distance(sites).withColumnRenamed("value", "point_dist"), cell_distance(grid, sites).withColumnRenamed("value", "cell_dist_coarse")
    whole = coarse.join(points, ["i", "j"]).join(cells, ["i", "j"])
    a, b = sites.toDF("i", "x1", "y1"), sites.toDF("j", "x2", "y2")
    close = points.where((F.col("j") < F.col("i")) & (F.col("point_dist") <= threshold_km)).join(a, "i").join(b, "j")
    span = F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))) * pad
    near = F.greatest(span, F.lit(2 * grid.yres))
    snap = lambda v, low, res, n: F.greatest(F.lit(0), F.least(F.lit(n), F.round((v - low) / res))).cast("int")
    c0, c1 = snap(F.least("x1", "x2") - near, grid.xmin, grid.xres, grid.ncol), snap(F.greatest("x1", "x2") + near, grid.xmin, grid.xres, grid.ncol)
    r0, r1 = snap(F.lit(grid.ymax) - F.greatest("y1", "y2") - near, 0.0, grid.yres, grid.nrow), snap(F.lit(grid.ymax) - F.least("y1", "y2") + near, 0.0, grid.yres, grid.nrow)
    close = close.select("i", "j", "x1", "y1", "x2", "y2", span.alias("span"), (r0 + 1).alias("r0"), F.greatest(r0 + 1, r1).alias("r1"), (c0 + 1).alias("c0"), F.greatest(c0 + 1, c1).alias("c1"))
    tiles = close.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    tiles = tiles.join(rose.df.select("row", "col", *DIRS), ["row", "col"])
    upwind = direction == "upwind"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.iloc[0]
        g = grid.sub(int(p.r0), int(p.r1), int(p.c0), int(p.c1))
        dense = np.full((g.nrow, g.ncol, 8), np.nan)
        dense[pdf.row.to_numpy() - int(p.r0), pdf.col.to_numpy() - int(p.c0)] = pdf[list(DIRS)].to_numpy(float)
        fact = max(1, int(np.floor(np.sqrt(max_nodes / g.ncell))))
        dense, g = refine(dense, fact, method), g.fine(fact)
        m = max(p.span, 2 * g.yres)
        r0, r1, c0, c1 = g.window(min(p.x1, p.x2) - m, max(p.x1, p.x2) + m, min(p.y1, p.y2) - m, max(p.y1, p.y2) + m)
        dense, g = dense[r0 - 1 : r1, c0 - 1 : c1], g.sub(r0, r1, c0, c1)
        at = []
        if not all(g.xmin <= x <= g.xmax and g.ymin <= y <= g.ymax for x, y in ((p.x1, p.y1), (p.x2, p.y2))):
            return pd.DataFrame({"i": [], "j": [], "w": [], "c": []})  # a site outside the grid keeps the coarse values
        for x, y in ((p.x1, p.y1), (p.x2, p.y2)):
            at.append((min(int((g.ymax - y) // g.yres), g.nrow - 1), min(int((x - g.xmin) // g.xres), g.ncol - 1)))
        ids = [r * g.ncol + c for r, c in at]
        fine = Graph(g.ncell, *_edges_of(dense, upwind))
        there, back = (fine.least([ids[s]])[ids[1 - s]] for s in (0, 1))
        lon, lat = ([g.xmin + (c + 0.5) * g.xres for _, c in at], [g.ymax - (r + 0.5) * g.yres for r, _ in at])
        km = float(geo.np_inverse(lon[0], lat[0], lon[1], lat[1])[0]) / 1000
        return pd.DataFrame({"i": [p.i, p.j], "j": [p.j, p.i], "w": [there, back], "c": [km, km]})

    fine = tiles.groupBy("i", "j").applyInPandas(local, "i int, j int, w double, c double")
    out = whole.join(fine, ["i", "j"], "left")
    return out.select("i", "j", F.coalesce("w", "wind_dist_coarse").alias("wind_dist"), "wind_dist_coarse", "point_dist", F.coalesce("c", "cell_dist_coarse").alias("cell_dist"), "cell_dist_coarse")
