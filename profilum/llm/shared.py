"""Intermediate tables in the shared folder of the cluster, and names that no table has."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Row, SparkSession

#: Jobs in which a bounded result comes to the driver at most.
FETCHES = 16
#: Bytes of a row group.
BLOCK_BYTES = 16 << 20
#: Where each stashed table lies.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new one if all work is on this machine, and else an error,
    as executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="profilum-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back, so that no later failure computes them anew."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # rows of large binaries: smaller row groups are held while they are written and read
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def same_stash(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df``, which reads the table ``of`` and nothing else that is stashed, to be discarded like it."""
    if of in _PATHS:
        _PATHS[df] = _PATHS[of]
    return df


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in stashed:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that are not among the columns, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fetched(df: DataFrame) -> Iterator[Row]:
    """The rows, in any order.  An iterator takes a job for each partition, and a shuffle may leave hundreds of small ones."""
    return df.coalesce(FETCHES).toLocalIterator(prefetchPartitions=True)


def release() -> None:
    """Give freed memory back to the system, where the C library has a call for it (glibc keeps up to 64 MB to itself)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
