"""Token counts of every prefix by dynamic programming, for a BPE sentencepiece model.

A BPE encoding is the only sequence of pieces in which each adjacent pair
stays as it is when encoded alone.  So the last piece of each prefix follows
from the last piece of a shorter one: among the pieces that end there, it is
the one that forms a stable pair with the last piece of what is before it.
That gives the exact count of every prefix from one pass, for all distinct
segments of a batch at once; the count of a longer prefix is a sum.

The counts are stored, as changes from character to character, a byte each as
a rule (``prefix_store``).  Questions about truncation and budgets (``fit``,
``cost``) read the store, never the text, and nothing is encoded again.

Cases: null or empty texts have no tokens; characters without a piece count
as their UTF-8 bytes; equal texts get equal counts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import pieces as P
from profilum.llm import text as X
from profilum.llm.shared import stash
from profilum.sources.tables import read_table

LIMIT = 4096


class PrefixCounter:
    """Exact token counts at every prefix."""

    def __init__(self, path: str) -> None:
        v = self.vocabulary = P.pieces(path)
        ids = [i for i in range(v.size) if i in v.text]
        ids.sort(key=lambda i: (len(v.text[i]) > 1, -v.score[i], i))
        #: place of a piece among the merges; single characters come first
        self.rank = np.full(v.size, -1, np.int64)
        self.rank[ids] = np.arange(len(ids))
        n = len(ids)
        left, right = np.arange(n), np.arange(n)
        keys, values = [], []
        for r, i in enumerate(ids):
            p = v.text[i]
            if len(p) == 1:
                continue
            splits = [(int(self.rank[a]), int(self.rank[b])) for k in range(1, len(p)) if (a := v.by_text.get(p[:k])) is not None and (b := v.by_text.get(p[k:])) is not None]
            keys += [a * n + b for a, b in splits]
            values += [r] * len(splits)
            done = self._merged(p, n)
            if done:
                left[r], right[r] = done
        self.n, self.left, self.right = n, left, right
        self.pair = P.HashMap(np.array(keys, X.U64), np.array(values, np.int64))
        self.seen = np.full(1 << 21, -1, np.int64)
        self.stable_ = np.zeros(1 << 21, bool)
        self.utf8 = lambda points: 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)

    def _merged(self, piece: str, n: int) -> tuple[int, int] | None:
        """The pair whose merge makes this piece, when it is encoded alone."""
        v, parts = self.vocabulary, list(piece)
        while len(parts) > 2:
            best, where = n, -1
            for k in range(len(parts) - 1):
                i = v.by_text.get(parts[k] + parts[k + 1])
                if i is not None and self.rank[i] < best:
                    best, where = int(self.rank[i]), k
            if where < 0:
                return None
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        found = [v.by_text.get(p) for p in parts]
        return None if None in found else (int(self.rank[found[0]]), int(self.rank[found[1]]))

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ranks a, b side by side stay so."""
        key = a * self.n + b
        slot = (X.mix64(key.astype(X.U64)) >> X.U64(43)).astype(np.int64)
        miss = np.flatnonzero(self.seen[slot] != key)
        out = self.stable_[slot]
        if len(miss):
            keys = np.unique(key[miss])
            good = self._stable(keys // self.n, keys % self.n)
            out[miss] = good[np.searchsorted(keys, key[miss])]
            slots = (X.mix64(keys.astype(X.U64)) >> X.U64(43)).astype(np.int64)
            self.seen[slots], self.stable_[slots] = keys, good
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later of the two merges again and again; a merge across that would have come first makes the pair unstable."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), self.n, np.int64)
        a, b = a.copy(), b.copy()
        while len(at):
            across = self.pair.get(a * self.n + b)
            bad = (across >= 0) & (across < limit)
            out[at[bad]] = False
            ok = ~bad
            at, a, b, limit = at[ok], a[ok], b[ok], limit[ok]
            split_a, split_b = self.right[a] != a, self.left[b] != b
            use_a = split_a & (~split_b | (a > b))
            use_b = ~use_a & split_b
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, self.right[a], a), np.where(use_b, self.left[b], b)
            go = use_a | use_b
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def prefixes(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of all prefixes (of 1, 2, ... characters) of separate segments, flat."""
        v = self.vocabulary
        chars = v.char[points].astype(np.int64)
        lengths = np.diff(offsets)
        place = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
        start, length, piece = v.edges(chars, np.repeat(lengths, lengths) - place)
        end = start + length - 1
        order = np.argsort(place[end], kind="stable")
        start, end, rank = start[order], end[order], self.rank[piece[order]]
        levels = np.searchsorted(place[end], np.arange(int(lengths.max(initial=0)) + 1))
        last = np.full(len(points), -1, np.int64)
        count = np.full(len(points), -1, np.int64)
        alone = v.single[chars] == P.UNKNOWN
        at_start = place == 0
        count[alone & at_start] = self.utf8(points[alone & at_start].astype(np.int64))
        for k in range(len(levels) - 1):
            s, e, r = (x[levels[k] : levels[k + 1]] for x in (start, end, rank))
            first = place[s] == 0
            before = last[np.maximum(s - 1, 0)]
            good = first.copy()
            test = np.flatnonzero(~first & (before >= 0))
            good[test] = self.stable(before[test], r[test])
            s, e, r, first = s[good], e[good], r[good], first[good]
            last[e] = r
            count[e] = np.where(first, 0, count[np.maximum(s - 1, 0)]) + 1
        return count

    def steps(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By how much each character of all texts (flat) changes the count of the prefix that ends with it, and the rows' offsets."""
        points, starts, rows, _ = self.vocabulary.segments(texts)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        lengths = np.diff(np.append(starts, len(points)))
        own, offsets, number, _ = P.distinct_segments(points, starts, P.segment_hashes(points, starts), np.arange(len(starts)))
        counts = self.prefixes(own, offsets)[X.expand(offsets[number], lengths)]
        step = counts.copy()
        step[1:] -= counts[:-1]
        step[starts] = counts[starts]
        # the space put before each text belongs to its first character
        lead = rows[:-1][np.diff(rows) > 0]
        step[lead + 1] += step[lead]
        kept = np.ones(len(points), bool)
        kept[lead] = False
        return step[kept], rows - np.concatenate([[0], np.cumsum(np.diff(rows) > 0)])

    def all_prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... text."""
        points, starts, _, _ = self.vocabulary.segments([text])
        if not len(points):
            return np.zeros(1, np.int64)
        inside = self.prefixes(points, np.append(starts, len(points)))
        ends = np.append(starts[1:], len(points)) - 1
        base = np.concatenate([[0], np.cumsum(inside[ends])[:-1]])
        out = inside + np.repeat(base, np.diff(np.append(starts, len(points))))
        out[0] = 0
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a model; built once in a process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


#: A document's stored counts: changes from character to character, as numbers of ``width`` bytes.
STORE = "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, width tinyint, steps binary"


def prefix_store(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """STORE of each document: exact token counts at every prefix, to be written and asked any number of times."""
    path = model or P.default_model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in X.slices(batches):
            _, offsets = X.utf8(batch.column(1))
            step, rows = own.steps(P.texts_of(batch.column(1)))
            total = np.concatenate([[0], np.cumsum(step)])
            narrow = step.astype(np.int8)
            data, width = [], []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                fits = a == b or np.abs(step[a:b]).max() < 128
                width.append(1 if fits else 4)
                data.append((narrow if fits else step.astype("<i4"))[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(rows), pa.int64()), pa.array(total[rows[1:]] - total[rows[:-1]], pa.int64()), pa.array(width, pa.int8()), pa.array(data, pa.binary())],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "width", "steps"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, STORE)


def stored_counts(width: int, steps) -> np.ndarray:
    """Token counts of the first 0, 1, 2, ... characters of a stored document."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8 if width == 1 else "<i4"), dtype=np.int64)])


def fit(store: DataFrame, budget: int | str) -> DataFrame:
    """The rows of a store and fit_chars: the longest prefix (in characters) of at most ``budget`` tokens, a number or a column.

    No text is read.  A null or negative budget fits nothing.
    """
    told = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    asked = store.withColumn("fit_chars", F.greatest(F.coalesce(told.cast("long"), F.lit(0)), F.lit(0)))
    # whole documents that fit need no look at their steps
    return _answered(asked, "fit_chars", lambda counts, most: np.flatnonzero(counts <= most)[-1], whole=lambda n_chars, n_tokens, most: np.where(n_tokens <= most, n_chars, -1))


def cost(store: DataFrame, chars: int | str) -> DataFrame:
    """The rows of a store and prefix_tokens: the tokens of the first ``chars`` characters, a number or a column, of all if there are fewer."""
    told = F.col(chars) if isinstance(chars, str) else F.lit(chars)
    asked = store.withColumn("prefix_tokens", F.greatest(F.coalesce(told.cast("long"), F.lit(0)), F.lit(0)))
    return _answered(asked, "prefix_tokens", lambda counts, at: counts[min(at, len(counts) - 1)], whole=lambda n_chars, n_tokens, at: np.where(at >= n_chars, n_tokens, -1))


def _answered(asked: DataFrame, name: str, answer: Callable[[np.ndarray, int], int], whole: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The question in column ``name`` replaced by its answer."""
    at = {c: asked.columns.index(c) for c in ("n_chars", "n_tokens", "width", "steps", name)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chars, n_tokens, question = (batch.column(at[c]).to_numpy() for c in ("n_chars", "n_tokens", name))
            out = whole(n_chars, n_tokens, question).astype(np.int64)
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = answer(stored_counts(batch.column(at["width"])[i].as_py(), batch.column(at["steps"])[i].as_buffer()), int(question[i]))
            yield batch.set_column(at[name], name, pa.array(out))

    return asked.mapInArrow(run, asked.schema)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_tokens, over_limit, and fit_chars (characters that fit the limit), read from stored prefix counts."""
    return answers(stash(prefix_store(docs, model, id_col, text_col), "prefixes"), limit)


def answers(store: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The same from a store."""
    return fit(store, limit).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts(read_table(spark, f"{sf_dir}/documents.parquet"))
