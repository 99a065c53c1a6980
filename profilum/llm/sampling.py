"""Sampled sentencepiece segmentations, reproducible by row key, and their lossless decoding.

All ways to cut a text into pieces form a lattice.  Forward filtering sums the
weight of all paths to each position; backward sampling walks from the end and
draws each piece by its share of that sum, so a whole segmentation is drawn
with probability in proportion to the product of its piece weights.  A piece
of merge rank r weighs (r + 2) ** -theta (Zipf's law): the model stores ranks,
not probabilities; a large theta comes near the best path, 0 draws all paths
alike.  Each draw depends on the seed, the row key and the position in the
text alone, so it is the same in any partitioning and on any retry.

Characters without a piece, and a written U+2581, become byte pieces, so
decoding always gives the text back.

Cases: null or empty texts have no tokens and decode to an empty text; a null
row key is a key of its own; rows with the same key and text get the same
tokens; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import pieces as P
from profilum.llm import text as X
from profilum.sources.tables import read_table

THETA = 1.0
SEED = 20240229
#: Text bytes worked on at once; the lattice takes about a hundred times as much.
SLICE = 512 << 10


class Sampler:
    """Draws segmentations from the piece lattice of one model."""

    def __init__(self, path: str, theta: float = THETA, seed: int = SEED) -> None:
        v = self.vocabulary = P.pieces(path)
        known = np.array(sorted(v.text), np.int64)
        order = known[np.lexsort((known, -v.score[known]))]
        rank = np.zeros(v.size)
        rank[order] = np.arange(len(order))
        self.weight = -theta * np.log(rank + 2)
        #: a character written as bytes
        self.fallback = -theta * np.log(v.size + 2.0)
        self.seed = X.mix64(np.array([seed], X.U64))[0]
        blobs = [b""] * v.size
        for i, p in v.text.items():
            blobs[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(v.bytes.tolist()):
            if i >= 0:
                blobs[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])

    def lattice(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges of separate segments, those of one end together: start, id (-1: bytes), cumulative probability; and the first edge of each end."""
        v = self.vocabulary
        chars = v.plain[points].astype(np.int64)
        lengths = np.diff(offsets)
        place = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
        start, length, piece = v.edges(chars, np.repeat(lengths, lengths) - place)
        weight = self.weight[piece]
        alone = np.flatnonzero(v.single[chars] == P.UNKNOWN)
        start = np.concatenate([start, alone])
        end = np.concatenate([start[: len(length)] + length - 1, alone])
        piece = np.concatenate([piece, np.full(len(alone), -1)])
        weight = np.concatenate([weight, np.full(len(alone), self.fallback)])
        order = np.argsort((place[end] << 40) + end, kind="stable")
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        levels = np.searchsorted(place[end], np.arange(int(lengths.max(initial=0)) + 1))
        total = np.full(len(points), -np.inf)
        share = np.empty(len(start))
        first_edge = np.zeros(len(points), np.int64)
        for k in range(len(levels) - 1):
            a, b = levels[k], levels[k + 1]
            if a == b:
                continue
            s, e = start[a:b], end[a:b]
            value = np.where(place[s] == 0, 0.0, total[np.maximum(s - 1, 0)]) + weight[a:b]
            first = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            sizes = np.diff(np.append(first, b - a))
            peak = np.repeat(np.maximum.reduceat(value, first), sizes)
            part = np.exp(value - peak)
            summed = np.repeat(np.add.reduceat(part, first), sizes)
            share[a:b] = part / summed
            total[e] = peak + np.log(summed)
            first_edge[e[first]] = a + first
        # summed edge by edge within each end, so that a text's sums do not depend on what else is in the batch
        first = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(end)))
        inside = share
        for k in range(1, int(sizes.max(initial=0))):
            at = first[sizes > k] + k
            inside[at] += inside[at - 1]
        inside[first + sizes - 1] = 2.0
        return start, piece, inside, first_edge

    def encode(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, flat, and the rows' offsets.  keys: a 64-bit number for each row."""
        v = self.vocabulary
        points, starts, rows, segments = v.segments(texts, plain=True)
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not len(starts):
            return np.zeros(0, np.int32), offsets
        # a written U+2581 differs from a space: hash them apart
        apart = np.where(points == P.SPACE, np.uint32(0x110000), points)
        own, bounds, number, _ = P.distinct_segments(points, starts, P.segment_hashes(apart, starts), np.arange(len(starts)))
        start, piece, reach, first_edge = self.lattice(own, bounds)
        row = X.row_of(segments)
        key = X.mix64(keys.astype(X.U64) ^ self.seed)[row]
        shift = (starts - rows[row]) - bounds[number]
        active = np.arange(len(starts))
        at = bounds[number + 1] - 1
        base = bounds[number]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            u = (X.mix64(key[active] + (at + shift[active]).astype(X.U64) * X.U64(0x9E3779B97F4A7C15)) >> X.U64(11)).astype(np.float64) * 2.0**-53
            edge = first_edge[at]
            beyond = np.flatnonzero(reach[edge] <= u)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[reach[edge[beyond]] <= u[beyond]]
            chosen = piece[edge].copy()
            low = chosen < 0
            chosen[low] = -1 - own[at[low]].astype(np.int64)
            steps.append((active, chosen))
            at = start[edge] - 1
            more = at >= base[active]
            active, at = active[more], at[more]
        count = np.zeros(len(starts), np.int64)
        for who, _ in steps:
            count[who] += 1
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]), np.int64)
        for k, (who, chosen) in enumerate(steps):
            flat[ends[who] - 1 - k] = chosen
        per_row = np.add.reduceat(np.append(count, 0), np.minimum(segments[:-1], len(count))) * (np.diff(segments) > 0)
        low = np.flatnonzero(flat < 0)
        if len(low):
            code = -1 - flat[low]
            size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            sizes = np.ones(len(flat), np.int64)
            sizes[low] = size
            out = np.repeat(flat, sizes)
            first = (np.cumsum(sizes) - sizes)[low]
            for k in range(4):
                has = size > k
                tail = size[has] - 1 - k
                byte = np.where(k > 0, 0x80 | (code[has] >> 6 * tail) & 0x3F, np.where(size[has] == 1, code[has], (0xF00 >> size[has]) & 0xFF | code[has] >> 6 * tail))
                out[first[has] + k] = v.bytes[byte]
            grown = np.concatenate([[0], np.cumsum(sizes)])
            edges = np.concatenate([[0], np.cumsum(per_row)])
            return out.astype(np.int32), grown[edges]
        return flat.astype(np.int32), np.concatenate([[0], np.cumsum(per_row)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows and their offsets; the space put before each text is taken away."""
        sizes = np.diff(self.blob_at)[ids]
        raw = self.blob[X.expand(self.blob_at[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        keep = np.ones(len(raw), bool)
        full = ends[:-1] < ends[1:]
        keep[ends[:-1][full]] = False
        return raw[keep], ends - np.concatenate([[0], np.cumsum(full)])


_SAMPLERS: dict[tuple, Sampler] = {}


def sampler(path: str, theta: float, seed: int) -> Sampler:
    """A sampler, built once in a process."""
    key = (path, theta, seed)
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(path, theta, seed)
    return _SAMPLERS[key]


def encode_sampled(docs: DataFrame, model: str | None = None, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and tokens: a segmentation drawn for the row key."""
    path = model or P.default_model()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path, theta, seed)
        for batch in X.slices(batches, limit=SLICE):
            keys = np.array([-1 << 62 if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            ids, offsets = own.encode(keys, P.texts_of(batch.column(1)))
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["doc_id", "text", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(draw, "doc_id bigint, text string, tokens array<int>")


def decode_tokens(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, tokens, and decoded: the text that the tokens stand for."""
    path = model or P.default_model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path, THETA, SEED)
        for batch in batches:
            tokens = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offsets = tokens.offsets.to_numpy().astype(np.int64)
            raw, ends = own.decode(tokens.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
            decoded = pa.Array.from_buffers(pa.large_utf8(), len(tokens), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoded.cast(pa.utf8())], names=["doc_id", "tokens", "decoded"])

    return rows.select("doc_id", "tokens").mapInArrow(read, "doc_id bigint, tokens array<int>, decoded string")


def roundtrip(docs: DataFrame, model: str | None = None, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_tokens, tokens (drawn), tokens_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, lossless."""
    path = model or P.default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path, theta, seed)
        for batch in X.slices(batches, limit=SLICE):
            keys = np.array([-1 << 62 if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            raw, at = X.utf8(batch.column(1))
            ids, offsets = own.encode(keys, P.texts_of(batch.column(1)))
            back, ends = own.decode(ids, offsets)
            data, known, stored = back.tobytes(), raw.tobytes(), ids.astype("<i4").tobytes()
            decoded = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array([hashlib.sha256(stored[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array([d == known[a:b] for d, a, b in zip(decoded, at[:-1], at[1:])]),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "tokens", "tokens_sha256", "decoded_sha256", "lossless"],
            )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, tokens array<int>, tokens_sha256 string, decoded_sha256 string, lossless boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every whole text, and what it decodes to."""
    return roundtrip(read_table(spark, f"{sf_dir}/documents.parquet"))
