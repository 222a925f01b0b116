"""Pairwise tables (i, j, value): means, ratios and the Mantel test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeway.plans.iterate import cut

#: What a permuted statistic must fall short by to count as smaller.
EPS = float(np.sqrt(np.finfo(float).eps))


def _both(pairs: DataFrame) -> DataFrame:
    t = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("other"))
    return pairs.join(t, ["i", "j"])


def pairwise_means(pairs: DataFrame) -> DataFrame:
    return _both(pairs).select("i", "j", ((F.col("value") + F.col("other")) / 2).alias("value"))


def pairwise_ratios(pairs: DataFrame, log: bool = True) -> DataFrame:
    """value(i, j) / value(j, i), or its logarithm. Of a table (i, value) of nodes: value(i) / value(j)."""
    if "j" not in pairs.columns:
        a, b = pairs.select("i", "value"), pairs.select(F.col("i").alias("j"), F.col("value").alias("other"))
        both = a.crossJoin(b)  # the matrix of nodes is the result
    else:
        both = _both(pairs)
    r = F.try_divide(F.col("value"), F.col("other"))
    return both.select("i", "j", (F.ln(r) if log else r).alias("value"))


def residuals(pairs: DataFrame, y: str, controls: list[str]) -> DataFrame:
    """pairs with y less its least-squares fit on an intercept and the controls; only sums reach the driver."""
    if not controls:
        return pairs
    terms: list[Column] = [F.lit(1.0), *(F.col(c) for c in controls)]
    k = len(terms)
    sums = pairs.agg(*(F.sum(terms[a] * terms[b]) for a in range(k) for b in range(k)), *(F.sum(t * F.col(y)) for t in terms)).first()
    coef = np.linalg.lstsq(np.array(sums[: k * k], float).reshape(k, k), np.array(sums[k * k :], float), rcond=None)[0]
    fit = sum((F.lit(float(b)) * t for b, t in zip(coef[1:], terms[1:], strict=True)), F.lit(float(coef[0])))
    return pairs.withColumn(y, F.col(y) - fit)


def average_rank(pairs: DataFrame, c: str) -> DataFrame:
    """c replaced by its rank, ties by the mean of theirs.

    Counts by value are dealt by ranges of values and written, so that ranges stay as they are; they are summed within each range, and
    only the ranges' totals, a row each, in one place.
    """
    counts = pairs.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
    counts = cut(counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_p").agg(F.sum("_n").alias("_t"))
    parts = parts.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = counts.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(parts), "_p")
    ranks = inside.select("_v", (F.col("_s") + F.col("_b") + (F.col("_n") + 1) / 2).alias("_r"))
    return pairs.join(ranks, F.col(c) == F.col("_v")).withColumn(c, F.col("_r")).drop("_v", "_r")


def _kendall(key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf.a.to_numpy(), pdf.b.to_numpy()
        con = ta = tb = 0.0
        for s in range(0, len(a), 512):  # blocks bound memory
            da, db = np.sign(a[s : s + 512, None] - a[None]), np.sign(b[s : s + 512, None] - b[None])
            con, ta, tb = con + (da * db).sum(), ta + (da != 0).sum(), tb + (db != 0).sum()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "stat": [con / np.sqrt(ta * tb)]})

    return run


def permutations(nodes: DataFrame, nperm: int) -> DataFrame:
    """perm, i, pi: for each of nperm numbers the nodes (i) in the order of md5(perm:i); the same in every run."""
    ranks = nodes.select("i", F.row_number().over(Window.orderBy("i")).alias("n"))  # a row for each site
    perms = nodes.sparkSession.range(1, nperm + 1).withColumnRenamed("id", "perm").crossJoin(ranks)
    order = Window.partitionBy("perm").orderBy(F.md5(F.concat(F.col("perm").cast("string"), F.lit(":"), F.col("i").cast("string"))))
    shuffled = perms.withColumn("m", F.row_number().over(order))
    return shuffled.join(ranks.select(F.col("i").alias("pi"), F.col("n").alias("m")), "m").select("perm", F.col("i"), "pi")


def mantel_test(x: DataFrame, y: DataFrame, z: list[DataFrame] | None = None, nperm: int = 999, method: str = "pearson",
                alternative: str = "two.sided", plus_one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row: stat, quantile, p_value; perm: perm, stat).

    Off-diagonal cells of x and y, both less their fit on the controls z, are correlated; then rows and
    columns of x are permuted together. quantile: share of permutations below stat. plus_one counts the
    observed statistic among them.
    """
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError("method must be pearson, spearman or kendall")
    if alternative not in ("two.sided", "less", "greater"):
        raise ValueError("alternative must be two.sided, less or greater")
    both = x.select("i", "j", F.col("value").alias("a")).join(y.select("i", "j", F.col("value").alias("b")), ["i", "j"]).where("i != j")
    names = []
    for n, c in enumerate(z or []):
        both = both.join(c.select("i", "j", F.col("value").alias(f"z{n}")), ["i", "j"])
        names.append(f"z{n}")
    both = residuals(residuals(both, "a", names), "b", names)
    if method == "spearman":
        both = average_rank(average_rank(both, "a"), "b")
    both = both.select("i", "j", "a", "b")
    perm = permutations(both.select("i").distinct(), nperm)
    p, q = perm.toDF("perm", "i", "pi"), perm.toDF("perm", "j", "pj")
    moved = both.select("i", "j", "b").join(p, "i").join(q, ["perm", "j"]).join(both.select(F.col("i").alias("pi"), F.col("j").alias("pj"), "a"), ["pi", "pj"])
    if method == "kendall":
        stats = moved.groupBy("perm").applyInPandas(_kendall("perm"), "perm long, stat double")
        stat = both.select(F.lit(0).cast("long").alias("one"), "a", "b").groupBy("one").applyInPandas(_kendall("one"), "one long, stat double").select("stat")
    else:
        stats, stat = moved.groupBy("perm").agg(F.corr("a", "b").alias("stat")), both.agg(F.corr("a", "b").alias("stat"))
    low = (F.col("s") < F.col("stat") - EPS).cast("double")
    share = (F.sum(low) + (0.5 if plus_one else 0.0)) / (F.count("*") + (1 if plus_one else 0))
    one = stats.select(F.col("stat").alias("s")).crossJoin(F.broadcast(stat)).groupBy("stat").agg(share.alias("quantile"))
    value = {"two.sided": (0.5 - F.abs(F.col("quantile") - 0.5)) * 2, "less": F.col("quantile"), "greater": 1 - F.col("quantile")}[alternative]
    return one.withColumn("p_value", value), stats
