"""Vectorised text primitives shared by the text operators.

Everything works on the UTF-8 bytes of a whole Arrow batch at once: words are
found as runs of bytes, hashed by multilinear hashing with random 64-bit
multipliers, and kept as flat arrays with one offset array per row.  Word
classes used here are unions of ASCII sets and "all bytes from 0x80", so a
run of bytes is a run of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes that are worked on at once; one longer text is worked on alone.
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same for the same seed."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix64(np.full(1, seed, U64))[0]) | U64(1)


_POWERS: dict[int, np.ndarray] = {}


def _byte_multipliers(n: int, seed: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        have = _POWERS[seed] = multipliers(max(n, 256), seed)
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of the column; rows stay whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.names.index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, cut at row bounds, and the n + 1 offsets of the rows in them."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(total, dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    source = place + np.repeat(starts.astype(np.int32), lengths)
    term = _byte_multipliers(int(lengths.max()), seed)[place]
    term *= raw[source].astype(U64) + U64(1)
    return mix64(np.add.reduceat(term, first) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, size: int, seed: int = 2) -> np.ndarray:
    """A hash of each run of ``size`` successive words; the last size - 1 starts have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    odd = multipliers(64, seed)
    level, length, step = mix64(hashes + odd[0]), 1, 1
    while length * 2 <= size:
        level = mix64(level[:-length] * odd[2 * step] + level[length:] * odd[2 * step + 1])
        length, step = length * 2, step + 1
    if length < size:
        level = mix64(level[: len(level) - (size - length)] * odd[2 * step] + level[size - length :] * odd[2 * step + 1])
    return level


def split_words(column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False, seed: int = 1):
    """raw, starts, ends, row offsets in words, word hashes of a column of texts."""
    raw, offsets = utf8(column)
    if lower:
        raw = LOWER[raw]
    starts, ends, rows = runs(table[raw], offsets)
    return raw, starts, ends, rows, word_hashes(raw, starts, ends, seed)


def row_of(rows: np.ndarray) -> np.ndarray:
    """For offsets of rows, the row of each element."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] numbers for each i, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(first - ahead, counts)
