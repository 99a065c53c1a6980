"""The five search modes."""

from __future__ import annotations

import logging
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.kernel.build import from_counts, reach, row_weights
from profilum.operators import hits as H
from profilum.operators import thresholds as TH
from profilum.operators.result import SearchResult
from profilum.options import ITERATIVE_INC_EVALUE, MoleculeType, ThresholdOptions
from profilum.plans import score as S
from profilum.sources.fasta import read_sequences, single_file
from profilum.sources.profiles import read_profiles
from profilum.sources.tables import kept

log = logging.getLogger(__name__)

Z_SCOPES = ("file", "corpus")


def _sequences(spark: SparkSession, source, molecule_type: MoleculeType) -> DataFrame:
    return read_sequences(spark, source, molecule_type)


def resolve_profiles(spark: SparkSession, source, registry=None) -> DataFrame:
    """Profiles from a DataFrame, a path, or the name of an installed database; a path wins over a name."""
    from profilum.sources.files import exists

    if isinstance(source, str) and not exists(spark, source):
        from profilum.databases import get_registry

        registry = registry or get_registry()
        info = registry.get(source)
        if info is None:
            raise FileNotFoundError(f"{source} is neither a path nor a known database")
        path = registry.get_path(source)
        if path is None:
            raise FileNotFoundError(f"database {source} is not installed; run: database install {source}")
        source = str(path)
    profiles = read_profiles(spark, source)
    if profiles.isEmpty():
        raise ValueError("no profiles")
    return profiles


def _check_alphabet(profiles: DataFrame, allowed: set[str]) -> None:
    found = {r[0] for r in profiles.select("alphabet").distinct().take(4)}
    if not found <= allowed or (found & {"dna", "rna"} and len({a.replace("rna", "dna") for a in found}) > 1):
        raise ValueError(f"profiles of alphabet {sorted(found)}; wanted {sorted(allowed)}")


def _space(sequences: DataFrame, z_scope: str, z: float | None):
    if z is not None:
        return z, []
    if z_scope not in Z_SCOPES:
        raise ValueError(f"z_scope must be one of {Z_SCOPES}")
    return (sequences.count(), []) if z_scope == "corpus" else (H.space_by_file(sequences), ["source_path"])


def _run(found: SearchResult, mode: str, output_dir: str | None, show_progress: bool) -> SearchResult:
    """The result; with ``output_dir`` written there now (a folder that all executors see) and read back."""
    if output_dir is None:
        return found
    path = f"{output_dir}/{mode}-{uuid.uuid4().hex}.parquet"
    if show_progress:
        log.info("%s: writing hits to %s", mode, path)
    found.to_parquet(path)
    return SearchResult.from_parquet(found.nested.sparkSession, path)


def _tasks(rows: DataFrame, threads: int) -> DataFrame:
    """Rows that at most ``threads`` tasks work on at once; 0: as many as there are cores."""
    if threads < 0:
        raise ValueError("threads must not be negative")
    return rows.coalesce(threads) if threads else rows


def _result(raw: DataFrame, profiles: DataFrame, options: ThresholdOptions, unit: list[str], query: list[str]) -> SearchResult:
    hits = H.ranked(H.thresholded(raw, profiles, options, unit), query)
    keys = ["source_path", "record_index", "profile_index", "strand"]
    hits = hits.withColumn("hit_id", F.xxhash64(*keys, F.element_at("domains", 1)["env_from"]))
    return SearchResult(H.nested(hits))


def search(spark: SparkSession, sequences, hmms, *, thresholds: ThresholdOptions | None = None, z_scope: str = "file", z: float | None = None, threads: int = 0, output_dir: str | None = None, show_progress: bool = True) -> SearchResult:
    """Profiles (queries) against proteins.  Z counts the target sequences of each file, or of the corpus, or is given."""
    options = thresholds or ThresholdOptions()
    profiles = resolve_profiles(spark, hmms)
    _check_alphabet(profiles, {"amino"})
    options = TH.require_cutoff(profiles, options)
    targets = _tasks(_sequences(spark, sequences, MoleculeType.PROTEIN), threads)
    space, unit = _space(targets, z_scope, z)
    raw = H.with_space(S.score(targets, S.pack(profiles)), space)
    return _run(_result(raw, profiles, options, ["profile_index", *unit], ["profile_index"]), "search", output_dir, show_progress)


def scan(spark: SparkSession, sequences, hmms, *, thresholds: ThresholdOptions | None = None, z: float | None = None, threads: int = 0, output_dir: str | None = None, show_progress: bool = True) -> SearchResult:
    """Proteins (queries) against profiles.  Z counts the profiles, with a cascade those of each cutoff."""
    options = thresholds or ThresholdOptions()
    profiles = resolve_profiles(spark, hmms)
    _check_alphabet(profiles, {"amino"})
    options = TH.require_cutoff(profiles, options)
    targets = _tasks(_sequences(spark, sequences, MoleculeType.PROTEIN), threads)
    raw = S.score(targets, S.pack(profiles))
    if z is not None or not options.cascade:
        raw = H.with_space(raw, z if z is not None else profiles.count())
        unit = ["source_path", "record_index"]
    else:
        kinds = TH.with_cutoffs(profiles, options).select("profile_index", F.coalesce("cutoff_type", F.lit("none")).alias("_kind"))
        raw = raw.join(kinds, "profile_index").join(kinds.groupBy("_kind").agg(F.count(F.lit(1)).alias("z")), "_kind")
        unit = ["source_path", "record_index", "_kind"]
    return _run(_result(raw, profiles, options, unit, ["source_path", "record_index"]), "scan", output_dir, show_progress)


def _no_cutoffs(options: ThresholdOptions) -> ThresholdOptions:
    if options.cutoff or options.cascade:
        raise ValueError("sequence queries have no cutoffs; use numeric thresholds")
    return options


def _plain(packed: DataFrame) -> DataFrame:
    """A profile table without cutoffs."""
    none = F.lit(None).cast("struct<seq:double,dom:double>")
    return packed.select("profile_index", "name", none.alias("ga"), none.alias("tc"), none.alias("nc"))


def phmmer(spark: SparkSession, query, target, *, thresholds: ThresholdOptions | None = None, z: float | None = None, threads: int = 0, output_dir: str | None = None, show_progress: bool = True) -> SearchResult:
    """Proteins of one file (or table) against those of another."""
    options = _no_cutoffs(thresholds or ThresholdOptions())
    queries = single_file(_sequences(spark, query, MoleculeType.PROTEIN), "query")
    targets = _tasks(single_file(_sequences(spark, target, MoleculeType.PROTEIN), "target"), threads)
    packed = kept(S.pack_sequences(queries))
    raw = H.with_space(S.score(targets, packed), z if z is not None else targets.count())
    return _run(_result(raw, _plain(packed), options, ["profile_index"], ["profile_index"]), "phmmer", output_dir, show_progress)


def _counts(rows: DataFrame, weigh: dict[int, np.ndarray] | None, lengths: dict[int, int], k: int) -> dict[int, tuple]:
    """Per profile, sums over aligned rows: kinds of symbols in columns (without weights), or weighted symbols and transitions.

    Each task sends its own sums, whose size the profiles' lengths bound.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(weigh) if weigh is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for frame in frames:
            for index, group in frame.groupby("profile_index"):
                index, m = int(index), lengths[int(index)]
                table, inserts = (np.array([np.asarray(v) for v in group[c]], np.int64).reshape(-1, m) for c in ("row", "inserts"))
                w = np.ones(len(table)) if sent is None else row_weights(table, sent.value[index], k)
                total = sums.setdefault(index, [np.zeros((m, k)), np.zeros((m + 1, 7)), 0.0, 0])
                for c in range(m):
                    total[0][c] += np.bincount(table[:, c], w, k + 1)[:k]
                total[1] += _steps(table, inserts, w, k)
                total[2] += w.sum()
                total[3] += len(table)
        yield pd.DataFrame([(i, pickle.dumps(v)) for i, v in sums.items()], columns=["profile_index", "sums"])

    out: dict[int, tuple] = {}
    for row in rows.mapInPandas(run, "profile_index bigint, sums binary").toLocalIterator():
        part = pickle.loads(bytes(row["sums"]))
        have = out.get(row["profile_index"])
        out[row["profile_index"]] = tuple(part) if have is None else tuple(a + b for a, b in zip(have, part))
    return out


def _steps(table: np.ndarray, inserts: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Weighted transitions between neighbouring columns."""
    m = table.shape[1]
    out = np.zeros((m + 1, 7))
    here, there, more = table[:, :-1] < k, table[:, 1:] < k, inserts[:, :-1]
    inside = (np.cumsum(table < k, 1)[:, :-1] > 0) & (np.cumsum((table < k)[:, ::-1], 1)[:, ::-1][:, 1:] > 0)
    w = w[:, None] * inside
    out[1:m, 0] = (w * (here & there & (more == 0))).sum(0)
    out[1:m, 1] = out[1:m, 3] = (w * (here & (more > 0))).sum(0)
    out[1:m, 4] = (w * np.maximum(more - 1, 0) * here).sum(0)
    out[1:m, 2] = (w * (here & ~there & (more == 0))).sum(0)
    out[1:m, 5] = (w * (~here & there)).sum(0)
    out[1:m, 6] = (w * (~here & ~there)).sum(0)
    return out


def jackhmmer(spark: SparkSession, query, target, *, thresholds: ThresholdOptions | None = None, max_iterations: int = 5, z: float | None = None, legacy_last_only: bool = False, threads: int = 0, output_dir: str | None = None, show_progress: bool = True) -> SearchResult:
    """Iterative search: each round's included hits make the next round's profile, until they stay the same.

    All queries are returned under their names; ``legacy_last_only`` keeps the
    last one only, under a constant name.
    """
    options = _no_cutoffs(thresholds or ThresholdOptions())
    if options.inc_evalue is None and options.inc_bitscore is None:
        options = ThresholdOptions(**{**vars(options), "inc_evalue": ITERATIVE_INC_EVALUE})
    queries = single_file(_sequences(spark, query, MoleculeType.PROTEIN), "query")
    targets = _tasks(single_file(_sequences(spark, target, MoleculeType.PROTEIN), "target"), threads)
    space = z if z is not None else targets.count()
    packed = kept(S.pack_sequences(queries))
    seen: dict[int, tuple[int, int]] = {}
    hits = None
    for round_ in range(max_iterations):
        raw = H.with_space(S.score(targets, packed), space)
        hits = H.without_duplicates(H.thresholded(raw, _plain(packed), options, ["profile_index"]), ["profile_index", "source_path", "record_index"]).persist()
        included = hits.where("seq_included")
        # one row a query: how many hits and a digest of which
        now = {r["profile_index"]: (r["n"], r["mark"]) for r in included.groupBy("profile_index").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(source_path, record_index))").alias("mark")).collect()}
        moved = [i for i, v in now.items() if seen.get(i) != v]
        seen = now
        if not moved or round_ == max_iterations - 1:
            break
        profiles = {r["profile_index"]: pickle.loads(bytes(r["packed"])) for r in packed.toLocalIterator()}
        rows = S.aligned_rows(targets, included.join(spark.createDataFrame([(i,) for i in moved], "profile_index bigint"), "profile_index", "left_semi"), packed).persist()
        lengths = {i: p.length for i, p in profiles.items()}
        kinds = _counts(rows, None, lengths, 20)
        sums = _counts(rows, {i: v[0] for i, v in kinds.items()}, lengths, 20)
        rows.unpersist()
        new = {i: from_counts(profiles[i], *v) for i, v in sums.items()}
        packed = spark.createDataFrame([(i, p.name, reach(new.get(i, p)), bytearray(pickle.dumps(new.get(i, p)))) for i, p in sorted(profiles.items())], packed.schema)
        hits.unpersist()
    if legacy_last_only:
        last = queries.agg(F.max("record_index")).first()[0]
        hits = hits.where(F.col("profile_index") == last).withColumn("hmm_name", F.lit("jackhmmer_query"))
    ranked = H.ranked(hits, ["profile_index"]).withColumn("hit_id", F.xxhash64("source_path", "record_index", "profile_index"))
    return _run(SearchResult(H.nested(ranked)), "jackhmmer", output_dir, show_progress)


def nhmmer(spark: SparkSession, sequences, hmms, *, thresholds: ThresholdOptions | None = None, z: float | None = None, threads: int = 0, output_dir: str | None = None, show_progress: bool = True) -> SearchResult:
    """Nucleotide profiles against both strands of nucleotide sequences.

    The search space is the residues searched (both strands of each file, or
    z) over the profile's window length.  A cutoff that a profile lacks is
    dropped for all with a warning.
    """
    options = thresholds or ThresholdOptions()
    profiles = resolve_profiles(spark, hmms)
    _check_alphabet(profiles, {"dna", "rna"})
    options = TH.require_cutoff(profiles, options, fall_back=True)
    targets = _tasks(_sequences(spark, sequences, MoleculeType.NUCLEOTIDE), threads)
    raw = S.score_nucleotides(targets, S.pack(profiles))
    if z is None:
        raw = raw.join(targets.groupBy("source_path").agg((2 * F.sum("length")).alias("_residues")), "source_path").withColumn("z", F.col("_residues") / F.col("reach"))
    else:
        raw = raw.withColumn("z", F.lit(float(z)) / F.col("reach"))
    return _run(_result(raw, profiles, options, ["profile_index", "source_path"], ["profile_index"]), "nhmmer", output_dir, show_progress)
