"""Searches over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from profilum.operators.result import SearchResult
from profilum.options import ThresholdOptions
from profilum.plans.search import search
from profilum.schema import RESULT


def sequence_stream(spark: SparkSession, folder: str, alphabet: str = "amino") -> DataFrame:
    """FASTA records of files that appear in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).select("value", F.col("_metadata.file_path").alias("source_path"))
    header = F.regexp_extract("value", r"^>?([^\r\n]*)", 1)
    return raw.select("source_path", F.regexp_extract(header, r"^\s*(\S*)", 1).alias("sequence_id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("residues"), F.lit(alphabet).alias("alphabet"))


def stream_search(spark: SparkSession, folder: str, hmms, output: str, checkpoint: str, z: float, thresholds: ThresholdOptions | None = None, on_batch: Callable[[int, SearchResult], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Searches each micro-batch and appends flat rows with their batch number to Parquet.

    The search space has to be given, as it can't be counted in a stream.  A
    batch that is run again after a failure overwrites what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        result = search(spark, batch, hmms, thresholds=thresholds, z=z)
        rows = result.df.select(*RESULT.fieldNames())
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")
        if on_batch:
            on_batch(number, result)

    writer = sequence_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
