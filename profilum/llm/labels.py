"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most (about; rows are taken by a hash of their id).
SAMPLE_ROWS = 16_000


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of about ``bound`` labelled rows among those that ``learn`` admits; doc_id decides which.

    A document with several labels counts with the largest, one with a null label not at all.  Of several texts under one
    id the one of least hash is taken (the first in order among equal hashes), a null text as empty, so that there are
    never more rows than labelled ids.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    # at most about ``bound`` rows of two numbers each
    chosen = F.broadcast(known) if bound <= 1 << 18 else known
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(chosen, "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"), F.max("label").alias("label")).select("doc_id", "least.text", "label")
