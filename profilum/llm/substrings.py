"""Removal of repeated passages: words under windows that occur more than once in the corpus.

A window of ``window`` words is estimated by a count-min sketch first.  What is
counted is the window's anchor, the ``gram``-word run in it with the least
hash: equal windows have equal anchors at equal places, so the anchor's count
is never below the window's, and there are about eight times fewer anchors
than windows.  Each partition fills a sketch of its own; the sketches are
merged cell by cell, and the cells counted at least twice reach the tasks as
bit maps of bounded size (``MAX_CELLS``).

A second pass takes the windows whose anchors are estimated repeated and
groups them exactly, by 96-bit hashes of all their words.  Within a task a
window that comes again is settled there and sent on once, so a passage of
any number of documents makes one entry a task.  A sketch that is too small
for the corpus sends more windows to the second pass and changes no result.

Decisions belong to texts: rows with the same text get the same, and each
counts as an occurrence of its windows.

Cases: null or empty texts have no words; texts of fewer words than a window
lose none; a window repeated within one text counts; repeated rows lose all
words if they have a window; extra columns are kept or ignored as said.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import text as X
from profilum.llm.shared import fetched, unused
from profilum.sources.tables import read_table

WINDOW, GRAM = 35, 20
#: Cells of each of the two sketch rows, at least and at most (a bit each in the tasks), and cells an expected anchor gets.
MIN_CELLS, MAX_CELLS, CELLS_PER_ANCHOR = 1 << 22, 1 << 30, 8
CHUNK_BITS = 20
#: Entries a task holds before it sends them, and windows of text per bucket of the exact grouping.
HELD, PER_BUCKET = 2_000_000, 4_000_000
#: Words of text per part of the merged runs.
PER_PART = 40_000_000


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """Minimum or maximum of each run of ``size`` values."""
    step = 1
    while step * 2 <= size:
        values = best(values[:-step], values[step:])
        step *= 2
    rest = size - step
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in both rows of the sketch."""
    bits = cells.bit_length() - 1
    return tuple((X.mix64(hashes * X.U64(odd)) >> X.U64(64 - bits)).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _window_starts(rows: np.ndarray, window: int) -> np.ndarray:
    """Word numbers at which a whole window of one row starts."""
    counts = np.maximum(np.diff(rows) - window + 1, 0)
    return X.expand(rows[:-1], counts)


def _anchors(hashes: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor hash of each window, and the hash of each distinct anchor place."""
    starts = _window_starts(rows, window)
    if not len(starts):
        none = np.zeros(0, X.U64)
        return starts, none, none
    grams = X.window_hashes(hashes, gram, seed=7)
    least = _sliding(grams, window - gram + 1, np.minimum)
    of_window = least[starts]
    # a place is an anchor if it is the least of any window over it
    spread = np.zeros(len(grams), X.U64)
    spread[starts] = of_window
    span = window - gram + 1
    most = _sliding(np.concatenate([np.zeros(span - 1, X.U64), spread]), span, np.maximum)
    return starts, of_window, grams[most == grams]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text")).where("length(text) > 0")


def text_key(text: Column) -> list[Column]:
    """128 bits of a text, as two numbers: hashes of the text, and of the text after one more character, which moves all
    its bytes, so that texts alike in one are not so in the other."""
    return [F.xxhash64(text), F.xxhash64(F.concat(F.lit("\u0001"), text))]


def repeated_cells(docs: DataFrame, cells: int, window: int = WINDOW, gram: int = GRAM, text_col: str = "text") -> list[np.ndarray]:
    """Bit maps of the two sketch rows: cells whose merged count is at least 2."""
    chunks = max(1, cells >> CHUNK_BITS)
    width = min(cells, 1 << CHUNK_BITS)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        for r, cell in enumerate(_cells(anchors, cells)):
            cell, count = np.unique(cell, return_counts=True)
            coded = ((cell & (width - 1)) << 1 | (count > 1)).astype(np.uint32)
            bounds = np.searchsorted(cell // width, np.arange(chunks + 1))
            full = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(full + r * chunks, pa.int32()), pa.array([coded[bounds[c] : bounds[c + 1]].tobytes() for c in full], pa.binary())], names=["chunk", "cells"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in X.slices(batches):
            _, _, _, rows, hashes = X.split_words(batch.column(0))
            _, _, places = _anchors(hashes, rows, window, gram)
            held.append(places)
            n += len(places)
            if n > HELD:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def merge(table: pa.Table) -> pa.Table:
        count = np.zeros(width, np.uint8)
        for part in table.column("cells"):
            coded = np.frombuffer(part.as_buffer(), np.uint32)
            count[coded >> 1] = np.minimum(count[coded >> 1] + 1 + (coded & 1).astype(np.uint8), 2)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary())})

    merged = _texts(docs, text_col).mapInArrow(fill, "chunk int, cells binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary")
    out = [np.zeros(max(1, cells >> 3), np.uint8) for _ in range(2)]
    for row in fetched(merged):
        r, c = divmod(row["chunk"], chunks)
        out[r][c * (width >> 3) : (c + 1) * (width >> 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


#: A run of repeated windows of a text: first word, and how many windows start from there on.
RUN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("place", "<i4"), ("count", "<i4")])


def _runs(keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Runs of places of texts (rows of ``keys``)."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(doc)) - 1
    out = np.zeros(len(first), RUN)
    out["k1"], out["k2"] = keys[doc[first]].T
    out["place"], out["count"] = place[first], place[last] - place[first] + 1
    return out


def _dealt(runs: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Runs by the part of their text."""
    to = (np.ascontiguousarray(runs["k1"]).view(X.U64) % X.U64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(bounds))
    return full, [runs[order[bounds[c] : bounds[c + 1]]].tobytes() for c in full]


def _merged(table: pa.Table) -> pa.Table:
    """One row a text, with its runs joined where they touch."""
    runs = np.concatenate([np.frombuffer(x.as_buffer(), RUN) for x in table.column("data")])
    runs = runs[np.lexsort((runs["place"], runs["k2"], runs["k1"]))]
    text = np.append(True, (runs["k1"][1:] != runs["k1"][:-1]) | (runs["k2"][1:] != runs["k2"][:-1]))
    number = np.cumsum(text) - 1
    end = (runs["place"] + runs["count"]).astype(np.int64) + (number << 32)
    start = runs["place"].astype(np.int64) + (number << 32)
    reach = np.maximum.accumulate(end)
    fresh = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(runs)) - 1
    joined = np.column_stack([runs["place"][first], reach[last] - start[first]]).astype(np.int32)
    bounds = np.append(np.flatnonzero(text[first]), len(first))
    lead = first[bounds[:-1]]
    return pa.table({"k1": pa.array(runs["k1"][lead]), "k2": pa.array(runs["k2"][lead]), "runs": pa.array([joined[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})


def _settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal (a, b) together, and the starts of their groups in it."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    return order, np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)


#: A window between tasks: 96 bits of hash, its text (by number in the message), its place, and whether it is settled already.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i4"), ("place", "<u4")])
SETTLED = np.uint32(1 << 31)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """k1, k2 (of a text) and runs (first word and how many windows start from there on) of windows that occur elsewhere too."""
    spark = docs.sparkSession
    n_bytes = _texts(docs, text_col).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # words of prose take about 6 bytes; this only sizes the sketch and the buckets
    anchors = n_bytes / 6 * 2 / (window - gram + 2)
    cells = int(min(MAX_CELLS, max(MIN_CELLS, 1 << int(np.ceil(np.log2(max(1.0, anchors * CELLS_PER_ANCHOR)))))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = (int(max(tasks, n_bytes / 6 // n)) for n in (PER_BUCKET, PER_PART))
    maps: Broadcast = spark.sparkContext.broadcast(repeated_cells(docs, cells, window, gram, text_col))

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([h[0] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held])
        doc = np.concatenate([h[1] + k for h, k in zip(held, base)])
        a, b, place = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        order, first = _settled(a, b)
        size = np.diff(np.append(first, len(order)))
        again = order[np.repeat(size > 1, size)]
        if len(again):
            to, data = _dealt(_runs(keys, doc[again], place[again]), parts)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - to, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])
        one = order[first]
        bucket = (a[one] % X.U64(buckets)).astype(np.int32)
        order_ = np.argsort(bucket, kind="stable")
        one, many, bucket = one[order_], (size > 1)[order_], bucket[order_]
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(bounds))
        data = []
        for c in full:
            own = one[bounds[c] : bounds[c + 1]]
            used, number = np.unique(doc[own], return_inverse=True)
            entry = np.zeros(len(own), ENTRY)
            entry["a"], entry["b"], entry["doc"] = a[own], b[own] >> X.U64(32), number
            entry["place"] = place[own].astype(np.uint32) | np.where(many[bounds[c] : bounds[c + 1]], SETTLED, np.uint32(0))
            data.append(np.int64(len(used)).tobytes() + np.ascontiguousarray(keys[used]).tobytes() + entry.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, held, n = maps.value, [], 0
        for batch in X.slices(batches):
            _, _, _, rows, hashes = X.split_words(batch.column(0))
            starts, least, _ = _anchors(hashes, rows, window, gram)
            if not len(starts):
                continue
            likely = np.ones(len(starts), bool)
            for bits, cell in zip(rows_of, _cells(least, cells)):
                likely &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            starts = starts[likely]
            if not len(starts):
                continue
            doc = np.searchsorted(rows, starts, "right") - 1
            keys = np.column_stack([batch.column(k).to_numpy() for k in (1, 2)])
            a, b = (X.window_hashes(hashes, window, seed)[starts] for seed in (11, 13))
            held.append((keys, doc, a, b, starts - rows[doc]))
            n += len(starts)
            if n > HELD:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def group(table: pa.Table) -> pa.Table:
        if (bucket := table.column("bucket")[0].as_py()) < 0:
            return pa.table({"part": pa.array([-1 - bucket] * table.num_rows, pa.int32()), "data": table.column("data")})
        keys, entries, base = [], [], 0
        for part in table.column("data"):
            raw = part.as_buffer()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            entry = np.frombuffer(raw, ENTRY, offset=8 + 16 * n).copy()
            entry["doc"] += base
            base += n
            keys.append(np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2))
            entries.append(entry)
        entry = np.concatenate(entries)
        order, first = _settled(entry["a"], entry["b"])
        size = np.diff(np.append(first, len(order)))
        settled = np.logical_or.reduceat(entry["place"][order] >= SETTLED, first)
        again = entry[order[np.repeat((size > 1) | settled, size)]]
        texts, number = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        to, data = _dealt(_runs(texts, number.reshape(-1)[again["doc"]], (again["place"] & ~SETTLED).astype(np.int64)), parts)
        return pa.table({"part": pa.array(to, pa.int32()), "data": pa.array(data, pa.binary())})

    text = F.col("text")
    entries = _texts(docs, text_col).select(text, *(k.alias(n) for k, n in zip(text_key(text), ("k1", "k2")))).mapInArrow(collect, "bucket int, data binary")
    found = entries.groupBy("bucket").applyInArrow(group, "part int, data binary")
    return found.groupBy("part").applyInArrow(_merged, "k1 bigint, k2 bigint, runs binary")


def _kept(column: pa.Array, found: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """raw, word starts, word ends, row offsets in words, and whether each word is kept."""
    raw, offsets = X.utf8(column)
    first, last, rows = X.runs(X.NOT_SPACE[raw], offsets)
    depth = np.zeros(len(first) + 1, np.int64)
    for i, packed in enumerate(found.to_pylist()):
        if packed:
            runs = np.frombuffer(packed, np.int32).reshape(-1, 2).astype(np.int64)
            np.add.at(depth, runs[:, 0] + rows[i], 1)
            np.add.at(depth, runs.sum(1) + rows[i] + window - 1, -1)
    return raw, first, last, rows, np.cumsum(depth)[:-1] == 0


def _joined(raw: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words joined by one space: bytes of all rows, and bounds (start, end) of each row in them."""
    size = last[kept] - first[kept]
    source = X.expand(first[kept], size + 1)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))].copy() if len(raw) else raw[:0]
    ends = np.cumsum(size + 1)
    out[ends - 1] = 0x20
    words = np.concatenate([[0], np.cumsum(kept)])[rows]
    at = np.concatenate([[0], ends])[words]
    return out.tobytes(), np.column_stack([at[:-1], np.maximum(at[1:] - 1, at[:-1])])


def _with_runs(docs: DataFrame, window: int, gram: int, text_col: str) -> DataFrame:
    """The rows with all their columns, and last the runs of their texts."""
    names = unused(docs.columns, "text_k1", "text_k2", "text_runs")
    found = repeated_windows(docs, window, gram, text_col).toDF(*names)
    keys = text_key(F.col(text_col).cast("string"))
    return docs.join(found, (keys[0] == F.col(names[0])) & (keys[1] == F.col(names[1])), "left").drop(*names[:2])


def dedup_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            raw, first, last, rows, kept = _kept(batch.column(1), batch.column(2), window)
            data, bounds = _joined(raw, first, last, rows, kept)
            removed = np.diff(np.concatenate([[0], np.cumsum(~kept)])[rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(rows), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in bounds.tolist()])],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _with_runs(small, window, gram, "text").mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """The rows with all their columns; texts that lose words are their kept words joined by one space."""
    names = docs.columns
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text_col):
            raw, first, last, rows, kept = _kept(batch.column(at), batch.column(len(names)), window)
            data, bounds = _joined(raw, first, last, rows, kept)
            lost = np.diff(np.concatenate([[0], np.cumsum(~kept)])[rows]) > 0
            texts = [data[a:b].decode() if c else t for (a, b), c, t in zip(bounds.tolist(), lost.tolist(), batch.column(at).to_pylist())]
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    marked = docs.withColumn(text_col, F.col(text_col).cast("string")) if dict(docs.dtypes)[text_col] != "string" else docs
    return _with_runs(marked, window, gram, text_col).mapInArrow(cut, marked.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts against each other."""
    return dedup_digest(read_table(spark, f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (k)),
g AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
kept AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u
  LEFT JOIN cov ON cov.doc_id = u.doc_id AND cov.p = u.p WHERE cov.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
