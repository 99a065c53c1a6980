"""Scoring jobs: profiles against sequence tables by the numpy kernel, in Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilum.functions.residues import DNA, reverse_complement
from profilum.kernel import dp
from profilum.kernel.build import from_sequence, reach
from profilum.kernel.model import Model, Profile, encode
from profilum.kernel.pipeline import model_of, search_batch
from profilum.schema import RAW_HITS

#: Profiles in one broadcast.  A worker has one broadcast in memory at a time, and one pass over the sequences uses all.
PROFILES_AT_ONCE = 1000
#: Residues of a kernel batch.
BATCH_RESIDUES = 2_000_000
PACKED = "profile_index bigint, name string, reach int, packed binary"


def pack(profiles: DataFrame) -> DataFrame:
    """profile_index, name, reach (the window length of long targets), packed: kernel profiles of the profile table."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from profilum.kernel.build import calibrate

        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                for c in ("stats_msv", "stats_viterbi", "stats_forward"):
                    row[c] = row[c] if isinstance(row[c], dict) else None
                row["compo"] = row["compo"] if row["compo"] is not None and len(row["compo"]) else None
                row["max_length"] = None if pd.isna(row["max_length"]) else int(row["max_length"])
                p = Profile.from_row(row)
                p = p if len(p.stats) == 3 else calibrate(p)
                rows.append((row["profile_index"], p.name, reach(p), pickle.dumps(p)))
            yield pd.DataFrame(rows, columns=["profile_index", "name", "reach", "packed"])

    return profiles.select("profile_index", "name", "alphabet", "match_nlog", "insert_nlog", "trans_nlog", "stats_msv", "stats_viterbi", "stats_forward", "compo", "max_length", "consensus").mapInPandas(build, PACKED)


def pack_sequences(queries: DataFrame, alphabet: str = "amino") -> DataFrame:
    """The same of single-sequence queries: one task calibrates a few, so all executors take part."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [from_sequence(name, residues, alphabet, index=i) for i, name, residues in zip(batch["record_index"], batch["sequence_id"], batch["residues"])]
            yield pd.DataFrame([(p.index, p.name, reach(p), pickle.dumps(p)) for p in made], columns=["profile_index", "name", "reach", "packed"])

    n = queries.sparkSession.sparkContext.defaultParallelism
    return queries.select("record_index", "sequence_id", "residues").repartition(n, "record_index").mapInPandas(build, PACKED)


def _chunks(packed: DataFrame) -> Iterator[list[Profile]]:
    held: list[Profile] = []
    for row in packed.orderBy("profile_index").toLocalIterator():
        p = pickle.loads(bytes(row["packed"]))
        p.index = row["profile_index"]
        held.append(p)
        if len(held) == PROFILES_AT_ONCE:
            yield held
            held = []
    if held:
        yield held


def _sent(spark: SparkSession, packed: DataFrame) -> list[Broadcast]:
    """The profiles in broadcasts; the driver holds one chunk at a time, and their files beside it."""
    return [spark.sparkContext.broadcast(chunk) for chunk in _chunks(packed)]


def _each(sent: list[Broadcast]) -> Iterator[list[Profile]]:
    """The chunks one by one, in a worker: of several, each is read from its file again when it is needed."""
    for chunk in sent:
        # encrypted broadcasts have no file to read again
        yield chunk.value if len(sent) == 1 or not hasattr(chunk, "_path") else chunk.load_from_path(chunk._path)


def _models(sent: list[Broadcast]) -> Iterator[Model]:
    """The models of all profiles one by one: each is far cheaper to make than to run over a batch of sequences."""
    for chunk in _each(sent):
        yield from map(model_of, chunk)


def _batches(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Pieces of about ``limit`` residues."""
    for frame in frames:
        if len(frame):
            part = frame["residues"].str.len().cumsum().floordiv(limit)
            for _, piece in frame.groupby(part, sort=False):
                yield piece


def _row(target: tuple, profile: Profile, strand: str | None, score: float, bias: float, lnp: float, domains: list) -> tuple:
    return (*target, profile.index, profile.name, strand, float(score), float(bias), float(lnp), [(float(d.score), float(d.bias), float(d.lnp), d.env_from, d.env_to, d.ali_from, d.ali_to, d.hmm_from, d.hmm_to) for d in domains])


def score(sequences: DataFrame, packed: DataFrame, batch_residues: int = BATCH_RESIDUES) -> DataFrame:
    """RAW_HITS of all profiles against all sequences, in one pass over these; rows depend on neither partitioning nor batches."""
    sent = _sent(sequences.sparkSession, packed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _batches(frames, batch_residues):
            codes = [encode(r, a) for r, a in zip(piece["residues"], piece["alphabet"])]
            targets = list(zip(piece["source_path"], piece["record_index"], piece["sequence_id"]))
            rows = [_row(targets[h.number], m.profile, None, h.score, h.bias, h.lnp, h.domains) for m in _models(sent) for h in search_batch(m, codes)]
            yield pd.DataFrame(rows, columns=RAW_HITS.fieldNames())

    return sequences.select("source_path", "record_index", "sequence_id", "residues", "alphabet").mapInPandas(run, RAW_HITS)


FILTER_SCORES = "profile_index bigint, source_path string, record_index bigint, msv double, viterbi double, forward double"


def filter_scores(sequences: DataFrame, packed: DataFrame, batch_residues: int = BATCH_RESIDUES) -> DataFrame:
    """FILTER_SCORES: log-odds of all profiles and sequences in each recurrence of the cascade, before any filter."""
    sent = _sent(sequences.sparkSession, packed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _batches(frames, batch_residues):
            x, lengths = dp.pad([encode(r, a) for r, a in zip(piece["residues"], piece["alphabet"])])
            for m in _models(sent):
                scores = {n: f(m, x, lengths) for n, f in (("msv", dp.msv), ("viterbi", dp.viterbi), ("forward", dp.forward))}
                yield pd.DataFrame({"profile_index": m.profile.index, "source_path": piece["source_path"].to_numpy(), "record_index": piece["record_index"].to_numpy(), **scores})

    return sequences.select("source_path", "record_index", "residues", "alphabet").where("length(residues) > 0").mapInPandas(run, FILTER_SCORES)


def windows_of(sequences: DataFrame, size: int, overlap: int) -> DataFrame:
    """Both strands cut into windows: adds strand, offset (of the window in its strand) and full_length."""
    both = sequences.withColumn("full_length", F.length("residues")).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).withColumn("residues", F.when(F.col("strand") == "+", F.col("residues")).otherwise(reverse_complement(F.col("residues"))))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.col("full_length") - overlap - 1, F.lit(0)), F.lit(step))
    return both.withColumn("offset", F.explode(starts)).withColumn("residues", F.substr("residues", F.col("offset") + 1, F.lit(size)))


def score_nucleotides(sequences: DataFrame, packed: DataFrame, batch_residues: int = BATCH_RESIDUES) -> DataFrame:
    """RAW_HITS with a strand: each domain on a long target is a hit of its own, in coordinates of the given strand's sequence
    (from > to on the reverse strand); what overlapping windows find twice stays once.  Adds reach, the profile's window length."""
    schema = T.StructType([*RAW_HITS.fields, T.StructField("reach", T.IntegerType())])
    sent = _sent(sequences.sparkSession, packed)
    # windows suit the profile that reaches farthest
    longest = packed.select(F.max("reach")).first()[0]
    if longest is None:
        return sequences.sparkSession.createDataFrame([], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _batches(frames, batch_residues):
            codes = [encode(r, "dna") for r in piece["residues"]]
            keys = list(zip(piece["source_path"], piece["record_index"], piece["sequence_id"], piece["strand"], piece["offset"], piece["full_length"]))
            rows = []
            for m in _models(sent):
                far = reach(m.profile)
                for h in search_batch(m, codes):
                    *target, strand, offset, n = keys[h.number]
                    for d in h.domains:
                        for c in ("env_from", "env_to", "ali_from", "ali_to"):
                            at = getattr(d, c) + int(offset)
                            setattr(d, c, at if strand == "+" else int(n) - at + 1)
                        rows.append((*_row(tuple(target), m.profile, strand, d.score, d.bias, d.lnp, [d]), far))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    cut = windows_of(sequences.select("source_path", "record_index", "sequence_id", "residues"), 4 * longest, longest)
    return without_overlaps(cut.mapInPandas(run, schema))


def without_overlaps(raw: DataFrame) -> DataFrame:
    """Of hits of one profile on one strand of one sequence whose envelopes share half of the shorter one, the best stays.

    Hits are compared in score order within windows of their neighbourhood: a
    hit goes if a better one overlaps it.
    """
    key = ["source_path", "record_index", "profile_index", "strand"]
    first = F.element_at("domains", 1)
    marked = raw.withColumn("_a", F.least(first["env_from"], first["env_to"])).withColumn("_b", F.greatest(first["env_from"], first["env_to"]))
    marked = marked.withColumn("_cell", F.floor(F.col("_a") / 1000))
    better = marked.select(*key, F.explode(F.sequence(F.floor((F.col("_a") - F.col("reach")) / 1000), F.floor(F.col("_b") / 1000))).alias("_cell"), F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.col("seq_score").alias("_s"))
    share = F.least("_b", "_d") - F.greatest("_a", "_c") + 1
    beats = (F.col("_s") > F.col("seq_score")) | ((F.col("_s") == F.col("seq_score")) & (F.col("_c") < F.col("_a")))
    lost = marked.join(better, [*key, "_cell"]).where((2 * share > F.least(F.col("_b") - F.col("_a"), F.col("_d") - F.col("_c")) + 1) & beats).select(*key, "_a", "_b").distinct()
    return marked.join(lost, [*key, "_a", "_b"], "left_anti").dropDuplicates([*key, "_a", "_b"]).drop("_a", "_b", "_cell")


def aligned_rows(sequences: DataFrame, included: DataFrame, packed: DataFrame) -> DataFrame:
    """profile_index, row (symbol of each column, K where none), inserts (residues after each column) of included hits' best domains."""
    pairs = included.select("source_path", "record_index", "profile_index")
    joined = sequences.select("source_path", "record_index", "residues", "alphabet").join(pairs, ["source_path", "record_index"])
    sent = _sent(sequences.sparkSession, packed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from profilum.kernel.domains import domains_of

        for frame in frames:
            groups = dict(list(frame.groupby("profile_index")))
            for chunk in _each(sent):
                rows = []
                for profile in chunk:
                    group = groups.get(profile.index)
                    if group is None:
                        continue
                    model = model_of(profile)
                    for residues, alphabet in zip(group["residues"], group["alphabet"]):
                        codes = encode(residues, alphabet)
                        _, _, domains = domains_of(model, codes)
                        if not domains:
                            continue
                        path = max(domains, key=lambda d: d.score).path
                        k = 20 if alphabet == "amino" else len(DNA)
                        row, inserts = np.full(model.length, k, np.int16), np.zeros(model.length, np.int16)
                        for (t, c), after in zip(path, (*path[1:], None)):
                            row[c] = min(int(codes[t]), k)
                            if after is not None and after[1] == c + 1:
                                inserts[c] = after[0] - t - 1
                        rows.append((profile.index, row, inserts))
                yield pd.DataFrame(rows, columns=["profile_index", "row", "inserts"])

    return joined.mapInPandas(run, "profile_index bigint, row array<smallint>, inserts array<smallint>")
