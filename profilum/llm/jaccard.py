"""Exact Jaccard self-join of word shingle sets by universe partitioning.

Two sets of sizes a <= b with a Jaccard similarity of t or more differ in at
most H = (1 - t) / (1 + t) * (a + b) elements.  Sizes fall into bands; within
a band the universe of shingles is hashed into m segments.  By the pigeonhole
principle at least m - H segments of two similar sets are equal, so under any
common order of segment values the first H + 1 values of either set share one:
only that subset of a set's segments is indexed, the rarest first.  How many
sets have a value is counted exactly: values are dealt to buckets, and those
that occur in several sets are sent back to their sets.  A set with H + 1
values of its own is similar to no other and needs no index at all.  A part of
the universe may instead go to q segments whose one-deletion neighbourhoods are
indexed: if fewer than 2q elements differ there, a segment differs in at most
one element and the neighbourhoods meet; otherwise at most H - 2q differ in the
rest.  ``allocate`` chooses q for each band by an estimate of cost from the
corpus's sizes.

Candidates are gathered as clusters (connected components of sets that share
an index value) and every pair in a cluster is verified exactly on the whole
sets.  Equal sets are one class from the start.  Large clusters are cut into
blocks, of which each pair is a task of bounded size.

Cases: see ``similar_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import text as X
from profilum.llm.components import components
from profilum.llm.shared import discard, fetched, stash, unused
from profilum.sources.tables import read_table

SHINGLE = 5
#: The similarity threshold as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Elements a segment with a deletion neighbourhood has on average.
NEIGHBOURS = 4
#: Segment values of a bucket, sets of a part, and shingles of a task of the verification.
PER_BUCKET, PER_PART, PER_TASK = 2_500_000, 30_000, 1_000_000
#: Bits of the filter of candidate sets, at least and at most.
FILTER_BITS, MAX_FILTER_BITS = 26, 31
#: Sets from which a value is hot, and how many of them a sample is to hold.
HOT, HOT_SAMPLE = 300_000, 256
#: Sets of an index value that are candidates pair by pair; more are checked in blocks.
SMALL = 64
#: Segments of the sets worked on at once.
CELLS = 1 << 22
#: Bits of a packed entry below the value: its kind (2 bits) and the number of its set in the message (16 bits).
LOW = 18
PLAIN, EMPTY, NEAR = 0, 1, 2
#: A set in a band: how many full segments it has, and how many values of a similar set's first ones meet its own.
OWNER = np.dtype([("sid", "<i8"), ("band", "<i4"), ("full", "<i4"), ("need", "<i4")])
SLICE = 8 << 20


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted (flat and offsets), and a 64-bit digest of each set."""
    _, _, _, rows, hashes = X.split_words(column, X.NOT_SPACE, lower=True)
    counts = np.diff(rows)
    whole = np.maximum(counts - size + 1, 0)
    grams = X.window_hashes(hashes, size)
    doc = np.repeat(np.arange(len(counts)), whole)
    values = grams[X.expand(rows[:-1], whole)] if len(grams) else np.zeros(0, X.U64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), X.U64)
        for i, d in enumerate(short):
            h = X.mix64(np.array([counts[d]], X.U64))
            for w in hashes[rows[d] : rows[d + 1]]:
                h = X.mix64(h * X.U64(0x9E3779B97F4A7C15) + w)
            extra[i] = h[0]
        doc, values = np.concatenate([doc, short]), np.concatenate([values, extra])
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, values = doc[order], values[order]
    if len(values):
        new = np.append(True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1]))
        doc, values = doc[new], values[new]
    offsets = np.searchsorted(doc, np.arange(len(counts) + 1))
    total = np.concatenate([np.zeros(1, X.U64), np.cumsum(X.mix64(values + X.U64(1)))])
    digest = X.mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(X.U64)).view(np.int64)
    return values, offsets, digest


def segments_of(upper):
    """Segments of the band of sizes below ``upper``: two elements each on average, and so many for small sets that hardly
    any set has too few full ones."""
    return np.select([upper <= 8, upper <= 16, upper <= 64, upper <= 128], [512, 128, 64, 128], upper // 2)


def allowed(n: np.ndarray) -> np.ndarray:
    """The most elements in which a similar set of the same or a larger size can differ from one of n elements."""
    top = n * DENOMINATOR // NUMERATOR
    return (DENOMINATOR - NUMERATOR) * (n + top) // (DENOMINATOR + NUMERATOR)


def allocate(sizes: dict[int, int]) -> dict[int, int]:
    """For each band (its number: sizes from 2**k) the number of segments with deletion neighbourhoods.

    sizes: about how many sets each band has.  Each index entry costs one.  A
    set without enough full segments must index empty ones, at which it meets
    all others of the band that must; one whose neighbourhood segment has an
    element at most indexes as many plain segments as without neighbourhoods.
    """
    chosen = {}
    for band, count in sizes.items():
        upper = 2 << band
        mean = 0.72 * upper
        best = None
        for q in range(4):
            rest = max(1.0, mean - q * NEIGHBOURS)
            m = int(segments_of(upper))
            full = m * (1 - (1 - 1 / m) ** rest)
            need = max(0.0, mean / 3 + 1 - 2 * q)
            empty, both = (1 - 1 / m) ** rest, (1 - 2 / m) ** rest if m > 2 else 0.0
            sigma = sqrt(max(m * empty * (1 - empty) + m * (m - 1) * (both - empty**2), 0.01))
            lacking = 0.5 * (1 - erf((full - need) / sigma / sqrt(2)))
            weak = 1 - (1 - exp(-NEIGHBOURS) * (1 + NEIGHBOURS)) ** q
            cost = count * (need + q * (1 + NEIGHBOURS) + weak * 2 * q) + (count * lacking) ** 2 * (1 - full / m)
            if best is None or cost < best[0]:
                best = (cost, q)
        chosen[band] = best[1]
    return chosen


class Signatures:
    """Segment values of sets."""

    def __init__(self, allocation: dict[int, int]) -> None:
        self.q = np.zeros(64, np.int64)
        for band, q in allocation.items():
            self.q[band] = q

    def values(self, flat: np.ndarray, offsets: np.ndarray, digest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Owners, and for each value the number of its owner, the value and its kind; first of all sets in their own
        bands, then of those that may be the smaller one of a pair in the next band."""
        n = np.diff(offsets)
        band = np.where(n > 0, np.frexp(np.maximum(n, 1).astype(float))[1] - 1, 0)
        for step in (0, 1):
            sets = np.flatnonzero(n > 0 if step == 0 else (n > 0) & (n * DENOMINATOR // NUMERATOR >= 2 << band))
            if len(sets):
                yield self._band(flat, offsets, sets, band[sets] + step, digest[sets])

    def _band(self, flat, offsets, sets, band, digest):
        count = np.diff(offsets)[sets]
        elements = flat[X.expand(offsets[sets], count)]
        upper = np.int64(2) << band
        m, q = segments_of(upper), self.q[band]
        who = np.repeat(np.arange(len(sets)), count)
        salt = X.mix64(band.astype(X.U64) + X.U64(101))
        mixed = X.mix64(elements ^ salt[who])
        high, low = mixed >> X.U64(32), mixed & X.U64(0xFFFFFFFF)
        share = np.minimum(0.5, q * NEIGHBOURS / (0.72 * upper))
        apart = (high >= ((1 - share) * 2.0**32).astype(X.U64)[who]) & (q[who] > 0)
        plain = ~apart
        base = np.cumsum(m) - m
        cell = base[who[plain]] + ((low[plain] * m[who[plain]].astype(X.U64)) >> X.U64(32)).astype(np.int64)
        total = int(m.sum())
        value = np.zeros(total, X.U64)
        np.add.at(value, cell, X.mix64(elements[plain] + X.U64(7)))
        filled = np.bincount(cell, minlength=total) > 0
        owner = np.repeat(np.arange(len(sets)), m)
        full = np.bincount(owner[filled], minlength=len(sets))
        # a neighbourhood segment of one element or none says too little: such a set indexes as without neighbourhoods
        slot = np.repeat(4 * np.arange(len(sets)), count)[apart] + ((low[apart] * q[who[apart]].astype(X.U64)) >> X.U64(32)).astype(np.int64)
        held = np.bincount(slot, minlength=4 * len(sets))
        weak = ((held.reshape(-1, 4) < 2) & (np.arange(4) < q[:, None])).any(1)
        need = np.maximum(allowed(count) + 1 - np.where(weak, 0, 2 * q), 0)
        # empty segments only count for sets that lack full ones
        used = filled | (full < need)[owner]
        place = np.flatnonzero(used)
        owner_ = owner[place]
        token = X.mix64(value[place] * X.U64(0x9E3779B97F4A7C15) + salt[owner_] + (place - base[owner_]).astype(X.U64))
        owners, values, kinds = [owner_], [token], [np.where(filled[place], PLAIN, EMPTY)]
        if (q > 0).any():
            k, h = who[apart], elements[apart]
            part = np.zeros(4 * len(sets), X.U64)
            own = X.mix64(h + X.U64(7))
            np.add.at(part, slot, own)
            every = X.expand(4 * np.arange(len(sets)), q)
            every, more = every[held[every] > 0], held[slot] > 1
            salted = lambda v, s: X.mix64(v * X.U64(0xC2B2AE3D27D4EB4F) + salt[s // 4] + (s % 4).astype(X.U64) + X.U64(977))
            owners += [every // 4, k[more]]
            values += [salted(part[every], every), salted((part[slot] - own)[more], slot[more])]
            kinds.append(np.full(len(every) + int(more.sum()), NEAR))
        table = np.zeros(len(sets), OWNER)
        table["sid"], table["band"], table["full"], table["need"] = digest, band, full, need
        return table, np.concatenate(owners), np.concatenate(values), np.concatenate(kinds)


def _first_seen(digest: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Sets that this task has not met before."""
    new = []
    for i, (d, k) in enumerate(zip(digest.tolist(), n.tolist())):
        if k and d not in seen:
            seen.add(d)
            new.append(i)
    return np.array(new, np.int64)


def _pick(flat: np.ndarray, offsets: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)[sets]
    return flat[X.expand(offsets[sets], size)], np.concatenate([[0], np.cumsum(size)])


def _describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid, mark of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, limit=SLICE):
            _, offsets, digest = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(digest), batch.column(2)], names=["doc_id", "n", "sid", "mark"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, sid bigint, mark bigint")


def _dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each destination."""
    order = np.argsort(to.astype(np.int32), kind="stable")
    to = to[order]
    bounds = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(bounds, np.append(bounds[1:], len(to))):
        yield int(to[a]), [c[a:b] for c in columns]


def _table(messages: list[tuple[int, int, bytes]]) -> pa.Table:
    """Messages: where to, the slice of the corpus they are about, and what they say."""
    return pa.table({"to": pa.array([m[0] for m in messages], pa.int32()), "slice": pa.array([m[1] for m in messages], pa.int64()), "data": pa.array([m[2] for m in messages], pa.binary())})


def _part(slice_: int | np.ndarray, parts: int):
    return (X.mix64(np.atleast_1d(np.asarray(slice_, np.int64)).view(X.U64)) % X.U64(parts)).astype(np.int64)


def _read(table: pa.Table, counted: bool) -> tuple[np.ndarray, ...]:
    """Packed entries, the number of the slice of each, the slices, and counts."""
    slices, number = np.unique(table.column("slice").to_numpy(), return_inverse=True)
    entries, often = [], []
    for part in table.column("data"):
        raw = part.as_buffer()
        n = raw.size // (10 if counted else 8)
        entries.append(np.frombuffer(raw, X.U64, n))
        if counted:
            often.append(np.frombuffer(raw, np.uint16, n, 8 * n))
    which = np.repeat(number, [len(e) for e in entries])
    return np.concatenate(entries) if entries else np.zeros(0, X.U64), which, slices, np.concatenate(often) if often else np.zeros(0, np.uint16)


def _pieces(n: np.ndarray) -> Iterator[slice]:
    """Runs of sets that take about CELLS segments together, and are few enough to be numbered."""
    band = np.frexp(np.maximum(n, 1).astype(float))[1]
    cells = np.cumsum(segments_of(np.int64(2) << band.astype(np.int64)))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
        to = min(to, at + (1 << 16))
        yield slice(at, to)
        at = to


def hot_values(docs: DataFrame, signatures: Signatures, sets: int) -> np.ndarray:
    """Values (without their low bits, in order) that about HOT sets have or more, by a sample of texts.

    They are few: sets times values a set, over HOT.  Which values are taken
    for hot decides how they are sent, and that they come last in the common
    order of values; it changes no result.
    """
    if sets < HOT:
        return np.zeros(0, X.U64)
    every = max(1, HOT // HOT_SAMPLE)
    sample = docs.select("text", F.xxhash64("text").alias("hash")).where(F.pmod("hash", F.lit(every)) == 0).dropDuplicates(["hash"]).select("text")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in X.slices(batches, limit=SLICE):
            flat, offsets, digest = shingle_sets(batch.column(0))
            new = _first_seen(digest, np.diff(offsets), seen)
            for piece in _pieces(np.diff(offsets)[new]):
                for _, _, value, _ in signatures.values(*_pick(flat, offsets, new[piece]), digest[new[piece]]):
                    found, count = np.unique(value >> X.U64(LOW), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count, pa.int64())], names=["value", "n"])

    found = sample.mapInArrow(values, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, HOT // every // 2))
    return np.sort(found.select("value").toArrow().column("value").to_numpy().view(X.U64))


def _pairs_of(value: np.ndarray, sid: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All pairs within each group of sets, which are small."""
    out = [np.zeros((0, 2), np.int64)]
    for n in np.unique(size):
        i, j = np.triu_indices(int(n), 1)
        group = sid[first[size == n][:, None] + np.arange(n)]
        out.append(np.column_stack([group[:, j].ravel(), group[:, i].ravel()]))
    return np.concatenate(out)


def _candidates(docs: DataFrame, signatures: Signatures, buckets: int, parts: int, hot: np.ndarray, among: np.ndarray | None = None) -> DataFrame:
    """Edges a, b (b the lesser) between sets that share an index value, and whether many share it.

    Each set is linked to the least of its value; with ``among``, a bit map of
    set digests, only those sets are taken, and values that few sets share
    give all their pairs.  A set is known by its slice (some sets of one task,
    named by a hash of them) and its number there, so an entry takes eight
    bytes; what is known of the sets of a slice is sent once.  A hot value is
    not counted, and the sets of one part that share a value are linked
    there, so no value brings more than SMALL entries a part to one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((hot, among))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hot, among = sent.value
        for batch in X.slices(batches, limit=SLICE):
            flat, offsets, digest = shingle_sets(batch.column(1))
            n = np.diff(offsets) if among is None else np.where(_marked(among, digest), np.diff(offsets), 0)
            new = _first_seen(digest, n, seen)
            for piece in _pieces(n[new]):
                own = new[piece]
                for step, (table, owner, value, kind) in enumerate(signatures.values(*_pick(flat, offsets, own), digest[own])):
                    name = int(X.mix64(np.array([X.mix64(table["sid"].astype(np.int64).view(X.U64)).sum() + X.U64(step)], X.U64)).view(np.int64)[0])
                    packed = (value >> X.U64(LOW) << X.U64(LOW)) | (kind.astype(X.U64) << X.U64(16)) | owner.astype(X.U64)
                    to = (X.mix64(value >> X.U64(LOW)) % X.U64(buckets)).astype(np.int64)
                    part, told = int(_part(name, parts)[0]), []
                    if len(hot):
                        known = hot[np.minimum(np.searchsorted(hot, value >> X.U64(LOW)), len(hot) - 1)] == value >> X.U64(LOW)
                        told.append((-1 - parts - part, name, packed[known].tobytes() + np.full(int(known.sum()), 65535, np.uint16).tobytes()))
                        packed, to = packed[~known], to[~known]
                    told += [(bucket, name, e.tobytes()) for bucket, (e,) in _dealt(to, packed)]
                    told.append((-1 - part, name, table.tobytes()))
                    yield from _table(told).to_batches()

    def count(table: pa.Table) -> pa.Table:
        """Values that several sets have go back to their sets, with how many those are."""
        if (to := table.column("to")[0].as_py()) < 0:
            to = to if to >= -parts else -1 - parts - to
            return _table([(to, s, d) for s, d in zip(table.column("slice").to_pylist(), table.column("data").to_pylist())])
        entry, which, slices, _ = _read(table, False)
        order = np.argsort(entry, kind="stable")
        entry, which = entry[order], which[order]
        value = entry >> X.U64(LOW)
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(value)))
        shared = np.repeat(size > 1, size)
        often = np.minimum(np.repeat(size, size)[shared], 65535).astype(np.uint16)
        return _table([(int(_part(slices[w[0]], parts)[0]), int(slices[w[0]]), e.tobytes() + n.tobytes()) for _, (e, n, w) in _dealt(which[shared], entry[shared], often, which[shared])])

    def choose(table: pa.Table) -> pa.Table:
        """The shared values among the first ones of each set, in the order of kind, count and value."""
        is_table = table.column("to").to_numpy() < 0
        tables = dict(zip(table.filter(pa.array(is_table)).column("slice").to_pylist(), table.filter(pa.array(is_table)).column("data").to_pylist()))
        entry, which, slices, often = _read(table.filter(pa.array(~is_table)), True)
        rows = [np.frombuffer(tables[s], OWNER) for s in slices.tolist()]
        base = np.cumsum([0] + [len(r) for r in rows])
        owner = np.concatenate([np.zeros(0, OWNER), *rows])
        set_ = base[which] + (entry & X.U64(0xFFFF)).astype(np.int64)
        value, kind = entry >> X.U64(LOW), (entry >> X.U64(16) & X.U64(3)).astype(np.int8)
        order = np.lexsort((value, often, kind, set_))
        set_, value, kind = set_[order], value[order], kind[order]
        first = np.flatnonzero(np.append(True, set_[1:] != set_[:-1])) if len(set_) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(set_))))
        plain, empty = (np.bincount(group[kind == k], minlength=len(first)) for k in (PLAIN, EMPTY))
        lead = owner[set_[first]]
        full, need = lead["full"].astype(np.int64), lead["need"].astype(np.int64)
        upper = np.int64(2) << lead["band"].astype(np.int64)
        lacking = np.where(full < need, segments_of(upper) - full, 0)
        take_plain = np.maximum(need - (full - plain), 0)
        take_empty = np.maximum(need - full - (lacking - empty), 0)
        rank = np.arange(len(set_)) - first[group]
        taken = np.where(kind == PLAIN, rank < take_plain[group], np.where(kind == EMPTY, rank - plain[group] < take_empty[group], True))
        sid, value = owner["sid"][set_[taken]], value[taken]
        order = np.lexsort((sid, value))
        sid, value = sid[order], value[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(value)))
        many = np.repeat(size > SMALL, size)
        edges = np.column_stack([sid, np.repeat(sid[first], size)])[many]
        lead = first[size > SMALL]
        here = int(table.filter(pa.array(is_table)).column("to")[0].as_py()) if is_table.any() else -1
        told = [(here, 0, edges.tobytes())] if len(edges) else []
        for flag, v, d in ((0, value[~many], sid[~many]), (1, value[lead], sid[lead])):
            told += [(bucket, flag, a.tobytes() + b.tobytes()) for bucket, (a, b) in _dealt((X.mix64(v) % X.U64(buckets)).astype(np.int64), v, d)]
        return _table(told)

    def stars(table: pa.Table) -> pa.Table:
        """Edges to the least set of each value; pairs of few sets if they are asked for."""
        raw = [x.as_buffer() for x in table.column("data")]
        if table.column("to")[0].as_py() < 0:
            pairs = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 2) for r in raw])
            few = pairs[:0]
        else:
            value = np.concatenate([np.frombuffer(r, X.U64, r.size // 16) for r in raw])
            sid = np.concatenate([np.frombuffer(r, np.int64, r.size // 16, r.size // 2) for r in raw])
            flag = np.repeat(table.column("slice").to_numpy() > 0, [r.size // 16 for r in raw])
            order = np.lexsort((sid, value))
            value, sid, flag = value[order], sid[order], flag[order]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(value)))
            least = np.repeat(sid[first], size)
            if sent.value[1] is None:
                pairs, few = np.column_stack([sid, least]), np.zeros((0, 2), np.int64)
            else:
                large = (size > SMALL) | (np.maximum.reduceat(flag, first) if len(first) else np.zeros(0, bool))
                pairs = np.column_stack([sid, least])[np.repeat(large, size)]
                few = _pairs_of(value, sid, first[~large], size[~large])
        pairs, few = (np.unique(x[x[:, 0] != x[:, 1]], axis=0).reshape(-1, 2) for x in (pairs, few))
        both = np.concatenate([pairs, few])
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()), "many": pa.array(np.arange(len(both)) < len(pairs))})

    message = "to int, slice bigint, data binary"
    counted = docs.mapInArrow(values, message).groupBy("to").applyInArrow(count, message)
    part = F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to"))
    chosen = counted.withColumn("part", part).groupBy("part").applyInArrow(lambda t: choose(t.drop_columns(["part"])), message)
    return chosen.groupBy("to").applyInArrow(stars, "a bigint, b bigint, many boolean")


def _marked(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether the hash of each set is set in a bit map."""
    cell = (X.mix64(digest.view(X.U64)) >> X.U64(64 - len(bits).bit_length() - 2)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """A bit map in which the hash of each node is set: 16 bits a node within fixed bounds.

    Beyond the larger bound (256 MB) it lets more sets pass that are no
    candidates, up to all, which the join after it drops.
    """
    bits = min(MAX_FILTER_BITS, max(FILTER_BITS, (16 * nodes.count()).bit_length()))
    width = 1 << (bits - 6)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [X.mix64(b.column(0).to_numpy().view(X.U64)) >> X.U64(64 - bits) for b in batches]
        cell = np.unique(np.concatenate(held).astype(np.int64)) if held else np.zeros(0, np.int64)
        bounds = np.searchsorted(cell // width, np.arange(65))
        full = np.flatnonzero(np.diff(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([(cell[bounds[c] : bounds[c + 1]] % width).astype(np.uint32).tobytes() for c in full], pa.binary())], names=["chunk", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        full = np.zeros(width, bool)
        for part in table.column("cells"):
            full[np.frombuffer(part.as_buffer(), np.uint32)] = True
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in fetched(nodes.mapInArrow(mark, "chunk int, cells binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary")):
        out[row["chunk"] * (width >> 3) : (row["chunk"] + 1) * (width >> 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


def link_sets(sets: list[np.ndarray], copies: np.ndarray, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Component labels (numbers of sets) and, for each set, how many copies of other sets it is linked with.

    ``across``: a block number for each set; then only pairs of different blocks count.
    """
    g = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    label, links = np.arange(g), np.zeros(g, np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(g), size)
    posting = owner[np.argsort(ids, kind="stable")]
    often = np.bincount(ids, minlength=len(values))
    first = np.cumsum(often) - often
    bounds = np.concatenate([[0], np.cumsum(size)])
    for i in range(g):
        own = ids[bounds[i] : bounds[i + 1]]
        own = own[often[own] > 1]
        if not len(own):
            continue
        common = np.bincount(posting[X.expand(first[own], often[own])], minlength=g)
        close = DENOMINATOR * common >= NUMERATOR * (size[i] + size - common)
        close[i] = False
        if across is not None:
            close &= across != across[i]
        if close.any():
            links[i] = copies[close].sum()
            joined = np.unique(np.append(label[close], label[i]))
            label[np.isin(label, joined[1:])] = joined[0]
    return label, links


def _stored(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """sid and shingles of the sets among the nodes, and of some others."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(nodes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in X.slices(batches, limit=SLICE):
            flat, offsets, digest = shingle_sets(batch.column(1))
            kept = _first_seen(digest, np.where(_marked(bits.value, digest), np.diff(offsets), 0), seen)
            yield pa.RecordBatch.from_arrays([pa.array(digest[kept]), pa.array([flat[offsets[i] : offsets[i + 1]].tobytes() for i in kept], pa.binary())], names=["sid", "shingles"])

    return docs.mapInArrow(sets, "sid bigint, shingles binary")


def _verify_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """sid, root, links as of ``_verify`` from pairs a, b (each once) with copies_a and copies_b."""
    sets = stash(_stored(docs, pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))).dropDuplicates(["sid"]), "pair-sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            close = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(v[i].as_buffer(), X.U64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                close[i] = DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)
            a, b, copies_a, copies_b = (batch.column(k).to_numpy()[close] for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in ((a, b), (b, b), (copies_b, copies_a))], names=["sid", "root", "links"])

    return both.select("a", "b", "copies_a", "copies_b", "x", "y").mapInArrow(check, "sid bigint, root bigint, links bigint")


def _verify(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """sid, root (least sid of the part of its component seen by a task), links.  clusters: sid, cluster, copies, block, blocks."""
    spark = docs.sparkSession

    def link(table: pa.Table) -> pa.Table:
        cluster, sid, block, copies = (table.column(c).to_numpy() for c in ("cluster", "sid", "block", "copies"))
        order = np.lexsort((sid, cluster))
        order = order[np.append(True, (sid[order][1:] != sid[order][:-1]) | (cluster[order][1:] != cluster[order][:-1]))]
        shingles = table.column("shingles").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bounds = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
        for a, b in zip(bounds, np.append(bounds[1:], len(order))):
            own = order[a:b]
            if len(own) < 2:
                continue
            two = np.unique(block[own])
            label, links = link_sets([np.frombuffer(shingles[int(i)].as_buffer(), X.U64) for i in own], copies[own], block[own] if len(two) > 1 else None)
            out.append((sid[own], sid[own][label], links))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("sid", "root", "links"), cols)})

    stored = _stored(docs, clusters.select("sid"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = clusters.withColumn("pair", F.explode(pairs)).withColumn("key", F.when(F.col("blocks") == 1, F.concat_ws(":", F.pmod(F.xxhash64("cluster"), F.lit(tasks * 4)))).otherwise(F.concat_ws(":", "cluster", "pair.i", "pair.j"))).drop("pair", "blocks")
    return stored.join(dealt, "sid").groupBy("key").applyInArrow(link, "sid bigint, root bigint, links bigint")


def _mark(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text.cast("string"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (documents it is linked with).

    A null text, or one without words, is an empty set, linked with nothing;
    its component is its own id.  Rows of equal sets are linked with each
    other, repeated rows as well.  A row without an id takes part and gets the
    least id of its component (null if there is none).  Any number of equal or
    similar rows, an empty table and extra columns work.
    """
    rows, sets, _ = _components(docs, id_col, text_col)
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("n > 0").join(sets, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(empty)


def _clusters(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """sid, cluster (the least set of a connected component of candidates), copies, block, blocks."""
    found = components(edges)
    nodes = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    known = nodes.select(F.col("node").alias("sid"), F.col("root").alias("cluster")).join(classes.select("sid", "copies", "n"), "sid")
    weight = known.groupBy("cluster").agg(F.ceil(F.sum("n") / PER_TASK).cast("int").alias("blocks"))
    out = stash(known.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).select("sid", "cluster", "copies", "block", "blocks"), "clusters")
    discard(found)
    return out


def _components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, n, sid, mark), the sets (sid, component_id, n_links), and the row of least id, then mark, of each component that has words."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a shingle takes about six bytes of text; this only guides the allocation and the numbers of buckets
    rough = texts.groupBy(F.floor(F.log2(F.greatest(F.octet_length("text") / 6, F.lit(1)))).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n")).where("band is not null").collect()
    signatures = Signatures(allocate({r["band"]: r["n"] for r in rough}))
    values, n = sum(r["n"] * 1.5 * 2 ** r["band"] for r in rough), sum(r["n"] for r in rough)
    dealt = signatures, max(8, int(values // PER_BUCKET)), max(8, n // PER_PART), hot_values(texts, signatures, n)
    rows = stash(_describe(texts.withColumn("mark", _mark(F.col("text")))), "sets")
    edges = stash(_candidates(texts, *dealt), "candidates")
    classes = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    clusters = _clusters(edges, classes)
    large = clusters.where("blocks > 1")
    if large.isEmpty():
        verified = stash(_verify(texts, clusters), "verified")
    else:
        # sets that only others link: large clusters are taken apart into those that share values of many sets, and single pairs
        edges_ = stash(_candidates(texts, *dealt, among=_filter_bits(large.select("sid"))), "candidates")
        cores = _clusters(edges_.where("many"), classes)
        near = edges_.where("NOT many").select("a", "b").distinct()
        for side in ("a", "b"):
            near = near.join(large.select(F.col("sid").alias(side), F.col("copies").alias(f"copies_{side}")), side).join(cores.select(F.col("sid").alias(side), F.col("cluster").alias(f"core_{side}")), side, "left")
        pairs = stash(near.where("core_a IS NULL OR core_b IS NULL OR core_a <> core_b").select("a", "b", "copies_a", "copies_b"), "pairs")
        # a core holds sets of large clusters alone, and the marks of the bit map may let in others, which are left to their own clusters
        own = cores.join(large.select("sid"), "sid", "left_semi")
        verified = stash(_verify(texts, clusters.where("blocks = 1").unionByName(own)).unionByName(_verify_pairs(texts, pairs)), "verified")
        discard(edges_, cores, pairs)
    discard(edges, clusters)
    roots = components(verified.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    per_set = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    per_root = per_set.groupBy("root").agg(F.min("least").alias("chosen"))
    named = stash(per_set.join(per_root, "root").select("sid", "least", "chosen", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "components")
    discard(verified, roots)
    return rows, named.select("sid", F.col("chosen.doc_id").alias("component_id"), "n_links"), named.where("least = chosen").select("chosen.doc_id", "chosen.mark")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: the one of least doc_id, and of least text hash among rows that share it.

    A component without any id keeps one row too.  Rows without words are
    components of their own: they stay, those repeated in id and text once.
    """
    rows, _, chosen = _components(docs)
    names = unused(docs.columns, "kept_id", "kept_mark")
    kept = chosen.unionByName(rows.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "mark")).select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (_mark(F.col("text")) == F.col(names[1]))
    known = docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    text = F.col("text").cast("string")
    return known.unionByName(docs.where(F.col("doc_id").isNull() & (text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"))))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against each other."""
    return similar_documents(read_table(spark, f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 75 * (x.n + y.n - o.c)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(l.n_links, 0) AS n_links
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""
