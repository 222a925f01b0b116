"""Random walks: diffusion of mass over a wind rose."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.grid import DIRS, STEPS, GridSpec
from galeway.operators.graph import adjacency
from galeway.operators.rose import WindRose
from galeway.plans.iterate import cut, discard

#: Dense arrays in one task up to this number of cells; joins beyond it.
KERNEL_CELLS = 1_000_000


@dataclass(frozen=True)
class WindWalk:
    """df(iter, cell, row, col, x, y, mass) of the recorded iterations."""

    df: DataFrame
    mode: str
    n_iter: int
    iter_length: float


def rw_max_step(rose: WindRose) -> float:
    """Hours in which the windiest cell loses all it has: 1 / the largest sum of conductances."""
    most = rose.df.agg(F.max(rose.total())).first()[0]
    return 1 / most


def rw_prob(rose: WindRose, t: float) -> DataFrame:
    """cell, row, col, stay, SW..S: shares of a cell's mass that stay or leave in a step of t hours."""
    cols: list[Column] = [(F.col(d) * t).alias(d) for d in DIRS]
    return rose.df.select("cell", "row", "col", (1 - rose.total() * t).alias("stay"), *cols)


def _kernel(start: DataFrame, prob: DataFrame, grid: GridSpec, record: list[int], iters: int, ratchet: bool) -> DataFrame:
    rows = prob.join(start, "cell", "left").select(F.lit(0).alias("g"), "row", "col", F.coalesce("mass", F.lit(0.0)).alias("mass"), "stay", *DIRS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf.row.to_numpy() - 1, pdf.col.to_numpy() - 1)
        there = np.zeros((grid.nrow, grid.ncol), bool)
        there[at] = True
        n, p = np.zeros(there.shape), np.zeros((9, *there.shape))
        n[at] = pdf.mass.to_numpy(float)
        for k, d in enumerate(("stay", *DIRS)):
            p[k][at] = np.nan_to_num(pdf[d].to_numpy(float))
        out = []
        for i in range(iters + 1):
            if i:
                new = n * p[0]
                for k, (dr, dc) in enumerate(STEPS):
                    a = (slice(max(0, -dr), grid.nrow - max(0, dr)), slice(max(0, -dc), grid.ncol - max(0, dc)))
                    b = (slice(max(0, dr), grid.nrow - max(0, -dr)), slice(max(0, dc), grid.ncol - max(0, -dc)))
                    new[b] += (n * p[k + 1])[a]
                new[~there] = 0
                n = np.maximum(n, new) if ratchet else new
            if i in record:
                out.append(pd.DataFrame({"iter": i, "row": at[0] + 1, "col": at[1] + 1, "mass": n[at]}))
        return pd.concat(out)

    df = rows.groupBy("g").applyInPandas(run, "iter int, row int, col int, mass double")
    return grid.with_coords(df.select("iter", grid.cell(F.col("row"), F.col("col")).alias("cell"), "mass"))


def _relational(start: DataFrame, prob: DataFrame, grid: GridSpec, record: list[int], iters: int, ratchet: bool) -> DataFrame:
    long = F.array(F.struct(F.lit(-1).alias("pk"), F.col("stay").alias("p")), *(F.struct(F.lit(k).alias("pk"), F.col(d).alias("p")) for k, d in enumerate(DIRS)))
    moves = adjacency(prob.select("cell", "row", "col", *DIRS), grid).select(F.col("cell").alias("src"), "dst", F.array(*DIRS)[F.col("k")].alias("p"))
    moves = moves.unionByName(prob.select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.col("stay").alias("p")))
    moves = cut(moves.join(prob.select(F.col("cell").alias("dst")), "dst", "left_semi").where("p is not null"))
    cells, mass = prob.select("cell"), cut(start)
    out = []
    for i in range(iters + 1):
        if i:
            new = mass.join(moves, F.col("cell") == F.col("src")).groupBy(F.col("dst").alias("cell")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
            if ratchet:
                new = new.unionByName(mass).groupBy("cell").agg(F.max("mass").alias("mass"))
            old, mass = mass, cut(new)
            if i - 1 not in record:  # else it is read later
                discard(old)
        if i in record:
            out.append(cells.join(mass, "cell", "left").select(F.lit(i).alias("iter"), "cell", F.coalesce("mass", F.lit(0.0)).alias("mass")))
    df = out[0]
    for o in out[1:]:
        df = df.unionByName(o)
    return grid.with_coords(df)


def random_walk(rose: WindRose, init: DataFrame, iters: int = 100, record: Iterable[int] | int | None = None, mode: str = "pulse", timescale: float = 1.0, strategy: str = "auto") -> WindWalk:
    """Mass after the recorded iterations.

    init: points (x, y), each distinct cell of which starts with mass 1, or (cell, mass). A step moves shares of
    each cell's mass to its neighbours by the cell's own rose; mass that leaves the grid or enters a
    missing cell is lost. mode "ratchet" keeps the most that a cell ever had. Points outside raise.
    """
    if not 0 < timescale <= 1:
        raise ValueError("timescale must be greater than 0 and no more than 1")
    if mode not in ("pulse", "ratchet"):
        raise ValueError("mode must be pulse or ratchet")
    record = sorted({iters} if record is None else {record} if isinstance(record, int) else set(record))
    if not record or record[0] < 0 or record[-1] > iters:
        raise ValueError("record must name iterations from 0 to iters")
    grid, t = rose.grid, rw_max_step(rose) * timescale
    if "mass" in init.columns:
        start = init.select("cell", "mass")
    else:
        start = init.select(grid.lookup(F.col("x"), F.col("y"))[0].alias("cell")).distinct()
        if not start.where("cell is null").isEmpty():
            raise ValueError("a starting point lies outside the grid")
        start = start.withColumn("mass", F.lit(1.0))
    if strategy == "auto":
        strategy = "kernel" if grid.ncell <= KERNEL_CELLS else "relational"
    run = _kernel if strategy == "kernel" else _relational
    return WindWalk(run(start, rw_prob(rose, t), grid, record, iters, mode == "ratchet").select("iter", "cell", "row", "col", "x", "y", "mass"), mode, iters, t)


def iter_length(walk: WindWalk) -> float:
    """Hours of an iteration."""
    return walk.iter_length
