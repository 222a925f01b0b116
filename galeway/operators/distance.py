"""Distances between sites and between the cells they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.functions import geo
from galeway.grid import GridSpec

#: Percent bounds of the discrepancy report, closed at both ends.
BINS = [(0.0, 1.0), (1.0, 2.5), (2.5, 5.0), (5.0, 10.0), (10.0, 25.0), (25.0, float("inf"))]


def _km(metric: str, *c: Column) -> Column:
    if metric not in ("geodesic", "haversine"):
        raise ValueError("metric must be geodesic or haversine")
    return geo.geodesic(*c)["km"] if metric == "geodesic" else geo.haversine_km(*c)


def kilometres(x1: str, y1: str, x2: str, y2: str, metric: str = "geodesic") -> Column:
    """Kilometres between the points of two pairs of columns."""
    return _km(metric, F.col(x1), F.col(y1), F.col(x2), F.col(y2))


def point_distance(sites: DataFrame, metric: str = "geodesic") -> DataFrame:
    """i, j, value: kilometres between all sites (site, x, y); the matrix is the result."""
    pairs = sites.toDF("i", "x1", "y1").crossJoin(sites.toDF("j", "x2", "y2"))
    return pairs.select("i", "j", _km(metric, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("value"))


def cell_distance(grid: GridSpec, sites: DataFrame, metric: str = "geodesic") -> DataFrame:
    """Kilometres between the centres of the sites' cells."""
    _, row, col = grid.lookup(F.col("x"), F.col("y"))
    return point_distance(sites.select("site", grid.x(col).alias("x"), grid.y(row).alias("y")), metric)


def check_cell_distance(grid: GridSpec, sites: DataFrame, metric: str = "geodesic") -> tuple[DataFrame, DataFrame]:
    """(ratios: i, j, cell_over_point; report: lo, hi, n, percent).

    The discrepancy exp(|ln ratio|) - 1 of unordered pairs is counted in BINS; a pair within one cell has an
    infinite one and counts in the last, and in the line (lo null, hi 0) for pairs of the same cell.
    """
    p, c = point_distance(sites, metric).withColumnRenamed("value", "p"), cell_distance(grid, sites, metric).withColumnRenamed("value", "c")
    both = p.join(c, ["i", "j"])
    ratios = both.select("i", "j", F.when(F.col("p") > 0, F.col("c") / F.when(F.col("p") > 0, F.col("p"))).alias("cell_over_point"))
    r = F.col("c") / F.when(F.col("p") > 0, F.col("p"))
    d = F.when(F.col("c") == 0, F.lit(float("inf"))).otherwise(F.greatest(r, 1 / F.when(r > 0, r)) - 1)
    upper = both.where("i < j").select(d.alias("d"), (F.col("c") == 0).alias("same"))
    spark = sites.sparkSession
    bins = spark.createDataFrame([(a / 100, b / 100, a, b) for a, b in BINS], "a double, b double, lo double, hi double")
    counts = upper.join(F.broadcast(bins), F.col("d").between(F.col("a"), F.col("b"))).groupBy("lo", "hi").agg(F.count("*").alias("n"))
    total = upper.agg(F.count("*").alias("total"), F.sum(F.col("same").cast("long")).alias("same"))
    lines = bins.select("lo", "hi").join(counts, ["lo", "hi"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).crossJoin(total)
    report = lines.select("lo", "hi", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))
    same = total.select(F.lit(None).cast("double").alias("lo"), F.lit(0.0).alias("hi"), F.col("same").alias("n"), (100.0 * F.col("same") / F.col("total")).alias("percent"))
    return ratios, report.unionByName(same)
