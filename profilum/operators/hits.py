"""From kernel scores to hits: search spaces, E-values, thresholds, and the flat and nested views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilum.functions.stats import evalue
from profilum.operators import thresholds as H
from profilum.options import ThresholdOptions
from profilum.schema import RESULT


def space_by_file(sequences: DataFrame) -> DataFrame:
    """source_path, z: target sequences in each file."""
    return sequences.groupBy("source_path").agg(F.count(F.lit(1)).alias("z"))


def with_space(raw: DataFrame, space: DataFrame | float | int, on: list[str] | None = None) -> DataFrame:
    """Adds z: a number for all, or a table with z for keys (files of a search, cutoff groups of a scan)."""
    if isinstance(space, DataFrame):
        return raw.join(space, on or ["source_path"])
    return raw.withColumn("z", F.lit(float(space)))


def thresholded(raw: DataFrame, profiles: DataFrame, options: ThresholdOptions, unit: list[str]) -> DataFrame:
    """Adds evalue, seq_reported, seq_included, dom_z, and domains with i_evalue, c_evalue, reported and included.

    raw has z; ``unit`` names the columns within which reported targets of one query are counted for c-E-values.
    """
    ruled = H.with_cutoffs(profiles, options).select("profile_index", "cutoff_type", "cutoff_seq", "cutoff_dom")
    hits = raw.join(ruled, "profile_index").withColumn("evalue", evalue(F.col("seq_lnp"), F.col("z")))
    hits = hits.withColumn("seq_reported", H.sequence_reported(options)).withColumn("seq_included", H.sequence_included(options))
    hits = hits.withColumn("dom_z", F.sum(F.col("seq_reported").cast("long")).over(Window.partitionBy(*unit)))
    valued = F.transform("domains", lambda d: d.withField("i_evalue", evalue(d["lnp"], F.col("z"))).withField("c_evalue", evalue(d["lnp"], F.col("dom_z"))))
    flagged = F.transform(valued, lambda d: d.withField("reported", F.col("seq_reported") & H.domain_reported(d, options)).withField("included", F.col("seq_reported") & H.domain_included(d, options)))
    return hits.withColumn("domains", flagged)


def nested(hits: DataFrame, sequence_id: str = "sequence_id", hmm_name: str | Column = "hmm_name") -> DataFrame:
    """Included hits with their reported domains; a scan swaps nothing here, as both names are kept by role."""
    kept = F.filter("domains", lambda d: d["reported"])
    shown = F.transform(kept, lambda d: F.struct(d["c_evalue"].alias("c_evalue"), d["i_evalue"].alias("i_evalue"), d["score"].alias("bitscore"), *(d[c].alias(c) for c in ("env_from", "env_to", "ali_from", "ali_to"))))
    model = F.col(hmm_name) if isinstance(hmm_name, str) else hmm_name
    hidden = [c for c in ("hit_id", "query_rank", "source_path", "record_index", "profile_index", "strand") if c in hits.columns and c != sequence_id]
    return hits.where("seq_included").select(*hidden, F.col(sequence_id).alias("sequence_id"), model.alias("hmm_name"), "evalue", F.col("seq_score").alias("bitscore"), shown.alias("domains"))


def flat(nested_hits: DataFrame) -> DataFrame:
    """One row for each domain, the 11 columns; a hit without domains gives none."""
    return nested_hits.select("sequence_id", "hmm_name", "evalue", "bitscore", F.explode("domains").alias("d")).select(
        "sequence_id", "hmm_name", "evalue", "bitscore", "d.c_evalue", "d.i_evalue", F.col("d.bitscore").alias("dom_bitscore"), "d.env_from", "d.env_to", "d.ali_from", "d.ali_to"
    ).select(*RESULT.fieldNames())


def regroup(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hits from flat rows: by hit_id where there is one, else by sequence and model."""
    keys = keys or (["hit_id", "sequence_id", "hmm_name"] if "hit_id" in rows.columns else ["sequence_id", "hmm_name"])
    domain = F.struct("env_from", "env_to", "ali_from", "ali_to", "c_evalue", "i_evalue", F.col("dom_bitscore").alias("bitscore"))
    return rows.groupBy(*keys).agg(F.max("evalue").alias("evalue"), F.max("bitscore").alias("bitscore"), F.array_sort(F.collect_list(domain)).alias("domains"))


def best_domain(nested_hits: DataFrame) -> DataFrame:
    """Adds best_domain: the domain of the largest bit score (the first of equals), null without domains."""
    best = F.aggregate("domains", F.try_element_at("domains", F.lit(1)), lambda a, d: F.when(d["bitscore"] > a["bitscore"], d).otherwise(a))
    return nested_hits.withColumn("best_domain", best)


def max_score_by_sequence(rows: DataFrame) -> DataFrame:
    """sequence_id and its largest bit score."""
    return rows.groupBy("sequence_id").agg(F.max("bitscore").alias("max_bitscore"))


def ranked(hits: DataFrame, query: list[str]) -> DataFrame:
    """Adds query_rank: the place of a hit within its query by significance."""
    order = [c for c in ("seq_lnp", "sequence_id", "record_index", "hmm_name") if c in hits.columns and c not in query]
    return hits.withColumn("query_rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order)))


def top_hits(hits: DataFrame, query: list[str], k: int) -> DataFrame:
    """The k most significant hits of each query."""
    return ranked(hits, query).where(F.col("query_rank") <= k)


def without_duplicates(hits: DataFrame, key: list[str]) -> DataFrame:
    """The most significant hit of each key."""
    order = [c for c in ("seq_lnp", "record_index") if c in hits.columns]
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
