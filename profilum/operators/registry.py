"""Registry tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.schema import DATABASES


def merge(bundled: DataFrame, state: DataFrame) -> DataFrame:
    """Bundled databases with their local state, and custom ones from the state alone."""
    local = state.select("name", F.col("installed").alias("_i"), F.col("path").alias("_p"), F.col("version").alias("_v"))
    known = bundled.join(local, "name", "left").select(
        "name", "url", "molecule_type", "domain", "has_thresholds", "citation", "notes",
        F.coalesce("_i", F.lit(False)).alias("installed"), F.col("_p").alias("path"), F.col("_v").alias("version"), F.lit(False).alias("custom"),
    )
    return known.unionByName(custom(bundled, state)).select(*DATABASES.fieldNames())


def custom(bundled: DataFrame, state: DataFrame) -> DataFrame:
    """Entries of the state that the user registered."""
    own = state.where("custom").join(bundled, "name", "left_anti")
    return own.select(
        "name", F.lit("").alias("url"), "molecule_type", F.lit(False).alias("domain"), F.lit(False).alias("has_thresholds"), F.coalesce("citation", F.lit("")).alias("citation"), F.lit(None).cast("string").alias("notes"),
        "installed", "path", "version", F.lit(True).alias("custom"),
    )


def listed(databases: DataFrame, molecule_type: str | None = None, installed_only: bool = False) -> DataFrame:
    """Databases by name."""
    if molecule_type:
        databases = databases.where(F.col("molecule_type") == molecule_type)
    if installed_only:
        databases = databases.where("installed")
    return databases.orderBy("name")


def usable_thresholds(table: DataFrame) -> DataFrame:
    """knum, threshold: rows of the side table whose threshold is a number."""
    return table.select("knum", F.expr("try_cast(threshold as double)").alias("threshold")).where("threshold IS NOT NULL")


def inject_thresholds(profiles: DataFrame, table: DataFrame) -> DataFrame:
    """Profiles with the threshold of their name as all three cutoffs; others keep what they have."""
    told = usable_thresholds(table).groupBy("knum").agg(F.max("threshold").alias("_t"))
    pair = F.struct(F.col("_t").alias("seq"), F.col("_t").alias("dom"))
    joined = profiles.join(told, profiles["name"] == told["knum"], "left")
    return joined.withColumns({c: F.when(F.col("_t").isNotNull(), pair).otherwise(F.col(c)) for c in ("ga", "tc", "nc")}).drop("knum", "_t")
