"""Readers of site tables and genotype files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.operators.pairwise import pairwise_means


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """site, x, y, n from a CSV with ID, longitude, latitude and n."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("ID").cast("int").alias("site"), F.col("longitude").cast("double").alias("x"), F.col("latitude").cast("double").alias("y"), F.col("n").cast("int").alias("n"))


def read_genepop(spark: SparkSession, path: str) -> DataFrame:
    """pop, ind, locus, a1, a2 from a genepop file of three-digit alleles; 000 is missing.

    Populations have no key in the file, only an order, so it is read as one text (a file has a row for each individual).
    """
    text = spark.read.text(path, wholetext=True)
    pops = text.select(F.posexplode(F.split("value", r"(?im)^\s*pop\s*$")).alias("pop", "body"))
    head = text.select(F.split(F.trim(F.element_at(F.split(F.element_at(F.split("value", r"(?im)^\s*pop\s*$"), 1), r"\r?\n"), 2)), r"\s*,\s*").alias("loci"))
    lines = pops.where("pop > 0").select("pop", F.explode(F.split("body", r"\r?\n")).alias("line")).where(F.col("line").contains(","))
    parts = lines.select("pop", F.trim(F.substring_index("line", ",", 1)).alias("ind"), F.posexplode(F.split(F.trim(F.substring_index("line", ",", -1)), r"\s+")).alias("k", "g"))
    allele = lambda a: F.when(F.substring("g", a, 3) != "000", F.substring("g", a, 3).cast("int"))
    named = parts.crossJoin(F.broadcast(head))  # one row
    return named.select("pop", "ind", F.get("loci", F.col("k")).alias("locus"), allele(1).alias("a1"), allele(4).alias("a2"))


def landscape(sites: DataFrame, div: DataFrame, mig: DataFrame, fst: DataFrame) -> dict[str, DataFrame]:
    """The tables of a landscape-genetic study: sites, nodes (i, value) and pairs; fst is made symmetric."""
    return {"sites": sites, "div": div, "mig": mig, "fst": pairwise_means(fst)}
