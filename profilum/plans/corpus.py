"""The driver's tables read as sequences and profiles, for queries that SQL can check.

Letters of texts that are residue codes make sequences; benchmark items make
profiles, with cutoffs set by their number so that every combination occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.functions.residues import only_residues
from profilum.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, alphabet: str = "amino") -> DataFrame:
    """Documents as sequences; their source plays the file."""
    residues = only_residues(F.coalesce("text", F.lit("")), alphabet)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_path"), F.col("doc_id").alias("record_index"), F.concat(F.lit("doc"), "doc_id").alias("sequence_id"), F.lit(None).cast("string").alias("description"),
        residues.alias("residues"), F.length(residues).alias("length"), F.lit(alphabet).alias("alphabet"),
    )


def _pair(every: int, score: float):
    return F.when(F.col("item_id") % every == 0, F.struct(F.lit(score).alias("seq"), F.lit(score / 2).alias("dom")))


def profiles(spark: SparkSession, sf_dir: str, alphabet: str = "amino") -> DataFrame:
    """Benchmark items as profiles: name, residues, cutoffs."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("profile_index"), F.concat(F.lit("bm"), "item_id").alias("name"), only_residues(F.coalesce("text", F.lit("")), alphabet).alias("residues"), F.lit(alphabet).alias("alphabet"),
        _pair(2, 30.0).alias("ga"), _pair(3, 40.0).alias("tc"), _pair(5, 24.0).alias("nc"),
    )


def queries_of(items: DataFrame) -> DataFrame:
    """Profiles as query sequences."""
    return items.select(F.lit("benchmark").alias("source_path"), F.col("profile_index").alias("record_index"), F.col("name").alias("sequence_id"), F.lit(None).cast("string").alias("description"), "residues", F.length("residues").alias("length"), "alphabet").where("length > 0")
