"""Lineage cuts for loops, and views."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='galeway-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/galeway-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def discard(*frames: DataFrame) -> None:
    """Delete now what cut() wrote for these, once nothing reads it any more."""
    for df in frames:
        if path := df.__dict__.get("cut_path"):
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    while _written:
        _delete(*_written.pop())


def register(**tables: DataFrame) -> None:
    """Make tables reachable by spark.sql under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
