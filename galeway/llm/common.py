"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let this session hand texts to Python in batches of a few MB, whatever their length: a worker holds one at a time."""
    for key, limit in (("spark.sql.execution.arrow.maxBytesPerBatch", most), ("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)):
        found = spark.conf.get(key, None)
        if found is None or not 0 < int(found.rstrip("bB")) <= limit:
            spark.conf.set(key, str(limit))


class Packed(NamedTuple):
    """frame: an operator's columns by its own names, all others as x0_, x1_, ..., which no operator uses; names: the caller's name of each."""

    frame: DataFrame
    names: dict[str, str]


def pack(df: DataFrame, **roles: str) -> Packed:
    """df with the columns of `roles` (own name = caller's name) under the own names and the others out of the way of all names."""
    if lost := set(roles.values()) - set(df.columns):
        raise ValueError(f"no columns {sorted(lost)}")
    inner = {c: r for r, c in roles.items()}
    names = {c: inner.get(c, f"x{i}_") for i, c in enumerate(df.columns)}
    return Packed(df.toDF(*names.values()), names)


def unpack(packed: Packed, df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """The caller's columns in their order, with `new` ones in place of those of the same names or after all."""
    old = {c: F.col(inner) for c, inner in packed.names.items()}
    return df.select(*(v.alias(c) for c, v in (old | dict(new)).items()))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='galeway-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galeway-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended: the folder is temporary anyway
        pass


def discard(df: DataFrame) -> None:
    """Delete the table of df now, if materialize() gave it and nothing reads it any more."""
    if path := df.__dict__.get("written_path"):
        _written.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def drop_written(keep: int = 0) -> None:
    """Delete tables that materialize() wrote, but for the first `keep`."""
    while len(_written) > keep:
        _delete(*_written.pop())


atexit.register(drop_written)


def salt_count(n_rows: int) -> int:
    """The root of the row count: it keeps both a salted subgroup and the list of a group's salts short."""
    return int(n_rows**0.5) + 1


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before each row of its group, in the order (bucket, *order).

    Two levels: rows within a bucket, then the buckets' totals within a group, so that no task
    sees a whole group. df is dealt out once, by group and bucket, and both levels reuse that.
    """
    dealt = df.repartition(*group, bucket)
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
    starts = totals.select(*group, bucket, F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_start"))
    rows = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(starts, [*group, bucket]).withColumn(out, F.col("_start") + F.col("_in")).drop("_start", "_in")
