"""Cutoffs of profiles and thresholds of hits as expressions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.options import CASCADE, DEFAULTS, BitscoreCutoff, ThresholdOptions


def cutoff_availability(profiles: DataFrame) -> DataFrame:
    """Per profile: name and whether it has gathering, trusted and noise cutoffs."""
    return profiles.select("name", *(F.col(k.column).isNotNull().alias(k.value) for k in BitscoreCutoff))


def best_cutoff(order: tuple[BitscoreCutoff, ...] = CASCADE) -> Column:
    """The first cutoff in the order that a profile has, null without any."""
    return F.coalesce(*(F.when(F.col(k.column).isNotNull(), F.lit(k.value)) for k in order))


def with_cutoffs(profiles: DataFrame, options: ThresholdOptions) -> DataFrame:
    """Adds cutoff_type, cutoff_seq and cutoff_dom: what rules each profile, null for the numeric options."""
    kind = F.lit(options.cutoff.value) if options.cutoff else best_cutoff() if options.cascade else F.lit(None).cast("string")
    chosen = F.coalesce(*(F.when(F.col("cutoff_type") == k.value, F.col(k.column)) for k in BitscoreCutoff))
    return profiles.withColumn("cutoff_type", kind).withColumn("cutoff_seq", chosen["seq"]).withColumn("cutoff_dom", chosen["dom"])


def all_have(profiles: DataFrame, kind: BitscoreCutoff) -> bool:
    """Whether every profile carries the cutoff."""
    return bool(profiles.agg(F.coalesce(F.bool_and(F.col(kind.column).isNotNull()), F.lit(True))).first()[0])


def require_cutoff(profiles: DataFrame, options: ThresholdOptions, fall_back: bool = False) -> ThresholdOptions:
    """Options for these profiles: a cutoff that some lack is an error, or with ``fall_back`` dropped with a warning."""
    if options.cutoff is None or all_have(profiles, options.cutoff):
        return options
    if not fall_back:
        raise ValueError(f"not every profile has a {options.cutoff.value} cutoff")
    warnings.warn(f"not every profile has a {options.cutoff.value} cutoff; falling back to E-values", stacklevel=2)
    return ThresholdOptions(**{k: v for k, v in vars(options).items() if not k.startswith("cut_")})


def _passes(score: Column, evalue: Column, cutoff: Column, least_score: float | None, most_evalue: float | None, default: float) -> Column:
    numeric = score >= least_score if least_score is not None else evalue <= (default if most_evalue is None else most_evalue)
    return F.when(cutoff.isNotNull(), score >= cutoff).otherwise(numeric)


def sequence_reported(o: ThresholdOptions) -> Column:
    """Over seq_score, evalue and cutoff_seq."""
    return _passes(F.col("seq_score"), F.col("evalue"), F.col("cutoff_seq"), o.bitscore, o.evalue, DEFAULTS["evalue"])


def sequence_included(o: ThresholdOptions) -> Column:
    """Over the same and seq_reported: inclusion is only tested for what is reported."""
    return F.col("seq_reported") & _passes(F.col("seq_score"), F.col("evalue"), F.col("cutoff_seq"), o.inc_bitscore, o.inc_evalue, DEFAULTS["inc_evalue"])


def domain_reported(domain: Column, o: ThresholdOptions) -> Column:
    """Over a domain with score and i_evalue, and cutoff_dom."""
    return _passes(domain["score"], domain["i_evalue"], F.col("cutoff_dom"), o.dom_bitscore, o.dom_evalue, DEFAULTS["dom_evalue"])


def domain_included(domain: Column, o: ThresholdOptions) -> Column:
    """The flag beside ``domain_reported``; it drops no rows."""
    return _passes(domain["score"], domain["i_evalue"], F.col("cutoff_dom"), o.inc_dom_bitscore, o.inc_dom_evalue, DEFAULTS["inc_dom_evalue"])
