"""Directed eight-neighbour graphs from wind roses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.grid import STEPS
from galeway.operators.rose import WindRose


def adjacency(cells: DataFrame, grid, wrap: bool = False) -> DataFrame:
    """cells with dst and k (position in DIRS) for each neighbour on the grid; with wrap, across the left and right edges."""
    offsets = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(STEPS)))
    e = cells.withColumn("o", F.explode(offsets)).withColumns({"k": F.col("o.k"), "r": F.col("row") + F.col("o.dr"), "c": F.col("col") + F.col("o.dc")})
    if wrap:
        e = e.withColumn("c", F.pmod(F.col("c") - 1, F.lit(grid.ncol)) + 1)
    e = e.where(F.col("r").between(1, grid.nrow) & F.col("c").between(1, grid.ncol))
    return e.withColumn("dst", grid.cell(F.col("r"), F.col("c"))).drop("o", "r", "c")


def wind_graph(rose: WindRose, direction: str = "downwind", wrap: bool = False, edge_fn: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """src, dst, k, conductance, cost: an edge's conductance is the mean of both cells' in its direction (upwind: the opposite one).

    edge_fn(from, to, k) replaces the mean. Cells without a rose, and edges without conductance, are
    absent. Two equi-joins' worth of rows: eight for each cell and side, whatever the grid.
    """
    if direction not in ("downwind", "upwind"):
        raise ValueError("direction must be downwind or upwind")
    fn = edge_fn or (lambda a, b, k: (a + b) / 2)
    long = rose.long().where("c is not null")
    if direction == "upwind":
        long = long.withColumn("k", ((F.col("k") + 4) % 8).cast("int"))
    to = long.select(F.col("cell").alias("dst"), F.col("k").alias("tk"), F.col("c").alias("to_c"))
    src = long.select(F.col("cell").alias("src"), "row", "col", F.col("k").alias("fk"), F.col("c").alias("from_c"))
    e = adjacency(src, rose.grid, wrap).where("k = fk and src != dst")
    e = e.join(to, (e["dst"] == to["dst"]) & (e["k"] == to["tk"])).select("src", e["dst"], "k", fn(F.col("from_c"), F.col("to_c"), F.col("k")).alias("conductance"))
    e = e.where("conductance > 0")
    if wrap and rose.grid.ncol < 3:  # both sides are one neighbour
        e = e.groupBy("src", "dst").agg(F.max(F.struct("conductance", "k")).alias("m")).select("src", "dst", "m.k", "m.conductance")
    return e.withColumn("cost", 1 / F.col("conductance"))


build_wind_graph = wind_graph


def transpose(edges: DataFrame) -> DataFrame:
    """The graph against the wind: src and dst change places."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), ((F.col("k") + 4) % 8).cast("int").alias("k"), "conductance", "cost")
