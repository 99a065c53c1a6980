"""A corpus from raw documents: toxic ones go, one of each near-duplicate group stays, repeated passages and
benchmark passages go, and what is left is cut into pieces.

Cases, for the chain as for each stage: a null or empty text is scored like any other, is no copy of another, loses no
words, shares none with the benchmark, and has no pieces, so it stays, once for each id; a row without an id takes part
and stays if its group has no row with one; repeated rows are copies of each other, so one stays; texts of any length
are worked on whole; an empty table of documents, labels or benchmark items works; more columns, by any name, are kept
by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import decontam, jaccard, sampling, substrings, toxicity
from profilum.llm.shared import discard, stash
from profilum.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model learnt on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.toxicity_model(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return jaccard.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words under windows of 35 words that occur more than once."""
    cut = substrings.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10 successive words (nor a whole shorter item) with the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document, and proof that it decodes to the text."""
    return sampling.roundtrip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece_encoding", encode),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it wrote."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
