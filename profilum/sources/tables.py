"""Parquet tables, spread over the cores where they come in few pieces, and tables that are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table; one of fewer splits than the cluster has cores is dealt out anew, so that all of them take part.

    Only small tables (or large ones in single row groups) have so few splits,
    so this never shuffles what is large for the cluster.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores * 2) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new one if all work is on this machine, and else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="profilum-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed now and written to the shared folder, so that a lost executor computes none of them anew."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
