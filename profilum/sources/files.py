"""Listing and text helpers that work in any store Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> tuple[list[tuple[str, int]], bool]:
    """Files (path, size) sorted by path, and whether the path was a folder; suffixes (any case) only matter in folders."""
    p = _path(spark, path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(p)
    if status.isFile():
        return [(status.getPath().toString(), status.getLen())], False
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile()]
    return sorted(f for f in found if f[0].lower().endswith(suffixes)), True


def parts(spark: SparkSession, path: str, suffix: str = ".txt") -> list[str]:
    """The files with rows in a folder that Spark wrote."""
    return [name for name, size in listed(spark, path, (suffix,))[0] if size]
