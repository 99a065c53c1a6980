"""Ungapped scoring by exact word seeds.

Words shared by a profile's consensus and a sequence are joined; matches on
one diagonal form runs, and runs chain to segments that gain ``MATCH`` a
matched residue and lose ``GAP`` a residue between runs.  The best segment of
each diagonal is a domain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 8
#: Residues cut at once, and bits of the filter of words.
BATCH_RESIDUES, FILTER_BITS = 2_000_000, 24
MATCH, GAP = 5, 4
#: Bits of a score point, and the exponential tail of bit scores.
BITS, TAU, LAMBDA = 0.5, 10.0, 0.7
_PACK = 1_000_000_000
DIAGONAL = ["profile_index", "source_path", "record_index", "diagonal"]


def _codes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the place in it (from 1) and the bytes as one number of all words of a batch."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    n = max(len(raw) - size + 1, 0)
    code = np.zeros(n, np.int64)
    for k in range(size):
        code = (code << 8) | raw[k : k + n]
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    inside = np.arange(n) + size <= bounds[row + 1]
    return row[inside], (np.flatnonzero(inside) - bounds[row[inside]] + 1), code[inside]


def _cells(code: np.ndarray) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def words(rows: DataFrame, key: list[str], residues: str = "residues", size: int = WORD, among: Broadcast | None = None) -> DataFrame:
    """The key, at (from 1) and word (its bytes as one number) of all words of each row.

    One pass over the bytes of a batch, so the work is in proportion to the
    length of sequences.  ``among``, a bit map of ``word_filter``, drops most
    words that it does not hold before they leave the task.
    """
    if not 0 < size <= 8:
        raise ValueError("words take one to eight residues")
    small = rows.select(*key, F.col(residues).alias("_residues")).where("_residues is not null")
    names = [*key, "at", "word"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if among is None else among.value
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(len(key))).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                # whole rows of about BATCH_RESIDUES
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_RESIDUES, "right")))
                part = batch.slice(at, to - at)
                at = to
                row, place, code = _codes(part.column(len(key)), size)
                if bits is not None:
                    cell = _cells(code)
                    kept = (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                    row, place, code = row[kept], place[kept], code[kept]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(len(key))), pa.array(place, pa.int32()), pa.array(code)], names=names)

    kinds = dict(small.dtypes)
    return small.mapInArrow(cut, ", ".join([*(f"{c} {kinds[c]}" for c in key), "at int, word bigint"]))


def word_filter(profile_words: DataFrame) -> np.ndarray:
    """A bit map of fixed size in which every word's cell is set; it only saves work, at any number of words."""
    width = 1 << (FILTER_BITS - 9)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_cells(batch.column(0).to_numpy())] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, width // 8)
        full = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed[c].tobytes() for c in full], pa.binary())], names=["chunk", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")])
        return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "bits": pa.array([joined.tobytes()], pa.binary())})

    out = np.zeros((1 << FILTER_BITS - 3) // (width // 8) * (width // 8), np.uint8).reshape(-1, width // 8)
    for row in profile_words.select("word").mapInArrow(mark, "chunk int, bits binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def matches(profiles: DataFrame, sequences: DataFrame, size: int = WORD) -> DataFrame:
    """profile_index, source_path, record_index, at (in the sequence), diagonal of all shared words.

    Words that no profile has are dropped where they are cut, by a bit map of
    fixed size; the join decides.  Profiles' words are the smaller side; Spark
    broadcasts them while they fit its threshold and shuffles both beyond.
    """
    p = words(profiles, ["profile_index"], size=size)
    known = profiles.sparkSession.sparkContext.broadcast(word_filter(p))
    s = words(sequences, ["source_path", "record_index"], size=size, among=known)
    return s.join(p.withColumnRenamed("at", "_p"), "word").select("profile_index", "source_path", "record_index", "at", (F.col("at") - F.col("_p")).alias("diagonal"))


def runs(found: DataFrame, size: int = WORD) -> DataFrame:
    """Maximal runs of matches on each diagonal: first and last residue."""
    key = DIAGONAL
    island = found.withColumn("_g", F.col("at") - F.row_number().over(Window.partitionBy(*key).orderBy("at")))
    return island.groupBy(*key, "_g").agg(F.min("at").alias("a"), (F.max("at") + size - 1).alias("b")).drop("_g")


def segments(found: DataFrame, size: int = WORD) -> DataFrame:
    """The best segment of each diagonal: score, seq_from, seq_to, hmm_from, hmm_to."""
    key = DIAGONAL
    along = Window.partitionBy(*key).orderBy("a")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = runs(found, size).withColumn("_gain", (F.col("b") - F.col("a") + 1) * MATCH).withColumn("_loss", F.coalesce(F.col("a") - F.lag("b").over(along) - 1, F.lit(0)) * GAP)
    r = r.withColumn("_sum", F.sum(F.col("_gain") - F.col("_loss")).over(upto)).withColumn("_base", F.col("_sum") - F.col("_gain"))
    r = r.withColumn("_low", F.min("_base").over(upto)).withColumn("_first", F.min(F.col("_base") * _PACK + F.col("a")).over(upto) - F.col("_low") * _PACK)
    r = r.withColumn("score", F.col("_sum") - F.col("_low"))
    best = r.groupBy(*key).agg(F.max_by(F.struct("score", "_first", "b"), F.struct("score", -F.col("b"))).alias("s"))
    return best.select(*key, F.col("s.score").cast("long").alias("score"), F.col("s._first").cast("int").alias("seq_from"), F.col("s.b").cast("int").alias("seq_to"), (F.col("s._first") - F.col("diagonal")).cast("int").alias("hmm_from"), (F.col("s.b") - F.col("diagonal")).cast("int").alias("hmm_to"))


def lnp(score: Column) -> Column:
    """Natural log of the P-value of a bit score."""
    return F.least(F.lit(-LAMBDA) * (score - TAU), F.lit(0.0))


def raw_hits(profiles: DataFrame, sequences: DataFrame, size: int = WORD) -> DataFrame:
    """RAW_HITS of the ungapped scores: each diagonal's best segment is a domain, the best domain scores the sequence."""
    bits = F.col("score") * BITS
    domain = F.struct(
        bits.alias("score"), F.lit(0.0).alias("bias"), lnp(bits).alias("lnp"), F.col("seq_from").alias("env_from"), F.col("seq_to").alias("env_to"),
        F.col("seq_from").alias("ali_from"), F.col("seq_to").alias("ali_to"), "hmm_from", "hmm_to",
    )
    hits = segments(matches(profiles, sequences, size), size).groupBy(*DIAGONAL[:-1]).agg(F.max(bits).alias("seq_score"), F.array_sort(F.collect_list(domain)).alias("domains"))
    named = hits.join(sequences.select("source_path", "record_index", "sequence_id"), ["source_path", "record_index"]).join(profiles.select("profile_index", F.col("name").alias("hmm_name")), "profile_index")
    return named.select("source_path", "record_index", "sequence_id", "profile_index", "hmm_name", F.lit(None).cast("string").alias("strand"), "seq_score", F.lit(0.0).alias("seq_bias"), lnp(F.col("seq_score")).alias("seq_lnp"), "domains")
