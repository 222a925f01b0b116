"""Wind series, sites, weights and matrices derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.grid import GridSpec

GRID = GridSpec(10, 12, -106.0, -94.0, 35.0, 45.0)
GLOBE = GridSpec(18, 36, -180.0, 180.0, -90.0, 90.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, calm: bool = False, holes: bool = False) -> DataFrame:
    """A step is 120 events; the last one is left out if it isn't full. calm: no wind where k is a multiple of 10; holes: no cells that 17 divides."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    n = e.count() // 120
    e = e.where(F.col("event_id") < n * 120)
    e = e.select(((F.col("event_id") % 120).cast("int") + 1).alias("cell"), F.expr("event_id div 120").alias("step"), "ts", "k", ((F.col("k") - 49.5) / 5).alias("u"), ((F.col("value") - 50) / 10).alias("v"))
    if calm:
        still = F.col("k") % 10 == 0
        e = e.withColumns({"u": F.when(still, 0.0).otherwise(F.col("u")), "v": F.when(still, 0.0).otherwise(F.col("v"))})
    if holes:
        e = e.where("cell % 17 != 0")
    return GRID.with_coords(e.drop("k"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("site"))
    at = lambda m, size: F.col("site") * m % 25 * size / 25.0 + 0.25
    return n.select("site", (F.lit(-106.0) + at(7, 12)).alias("x"), (F.lit(35.0) + at(11, 10)).alias("y"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").where("p_partkey < 120")
    return p.select((F.col("p_partkey") + 1).alias("cell"), F.when(F.col("p_size") % 5 == 0, 0.1).otherwise(1.0).alias("w"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asymmetric pairs: trade between customers' and suppliers' nations."""
    o, c, s = (_table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    j = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg((F.sum("l_extendedprice") / 1e6).alias("value"))


def formula_pairs(spark: SparkSession, a: int = 31, b: int = 17, m: int = 97) -> DataFrame:
    """25 x 25 asymmetric values in 1..2."""
    i, j = spark.range(25).select(F.col("id").cast("int").alias("i")), spark.range(25).select(F.col("id").cast("int").alias("j"))
    return i.crossJoin(j).withColumn("value", 1 + ((F.col("i") * a + F.col("j") * b + F.col("i") * F.col("j") * 7) % m) / float(m))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("i")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("value"))


def globe(spark: SparkSession) -> DataFrame:
    return GLOBE.cells(spark).withColumn("z", F.col("cell") * 37 % 101 / 10.0)
