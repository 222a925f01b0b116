"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeway.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b); root is the smallest node reachable.

    Alternating large and small stars: neighbours above a node, then those below, are hung on
    its smallest neighbour, until no edge changes. The edges never grow in number; they are rewritten to shared
    storage in each round, and nothing but two figures about them reaches the driver.
    """
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        # written first: plain scans under the join, so that a hub's edges are split
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        hung = both.join(least, "a")
        hung = hung.where("b > a") if large else hung.where("b != m")
        new = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return new if large else new.unionByName(least.select("a", F.col("m").alias("b")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = materialize(edges.where("a != b").select(hi, lo).distinct())
    before = mark(e)
    while before[0]:
        new = star(e, True).where("a != b").select(hi, lo).distinct()
        new = materialize(star(new, False).where("a != b").select(hi, lo).distinct())
        discard(e)
        e = new
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
