"""Document quality: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts, for a batch at once.  Trees are
grown on binned statistics with logistic loss and stored as flat arrays (a
complete binary tree of fixed depth each), so scoring is a few gathers for all
rows and trees together.

Fitted on a bounded sample of labelled rows (``labels.SAMPLE_ROWS``); texts
are the only input of a score.

Cases: null or empty texts have all-zero statistics and are scored from them;
without labelled rows of both classes every score is the share of label 1 (0
without any); equal texts get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import text as X
from profilum.llm.labels import SAMPLE_ROWS, labelled_sample, remainder
from profilum.sources.tables import read_table

STATISTICS = (
    "log_words", "mean_word", "spread_word", "log_lines", "words_a_line", "upper", "capitalised", "digits", "high_bytes", "spaces",
    "commas", "stops", "exclaims", "questions", "pipes", "hashes", "dollars", "percents", "ampersands", "stars", "other_marks",
    "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "stop_words_a_word", "short_words", "long_words", "marked_words", "adjacent_repeats", "controls", "brackets",
)
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 150, 4, 0.1, 1.0, 5


def _repeats(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values and the count of the most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    size = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[first], size)
    return np.bincount(r[first], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    raw, offsets = X.utf8(column)
    n = len(column)
    starts, ends, rows = X.runs(X.NOT_SPACE[raw], offsets)
    hashes = X.word_hashes(raw, starts, ends)
    row, lengths = X.row_of(rows), (ends - starts).astype(float)
    per = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets]).astype(float)
    each = lambda v: np.bincount(row, v, n) if len(row) else np.zeros(n)
    size, words = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(np.diff(rows), 1).astype(float)
    from_, to, lines = X.runs(raw != 10, offsets)
    line_row = X.row_of(lines)
    n_lines = np.maximum(np.diff(lines), 1).astype(float)
    line_kinds, _ = _repeats(X.word_hashes(raw, from_, to), line_row, n)
    word_kinds, top = _repeats(hashes, row, n)
    pairs = X.window_hashes(hashes, 2)
    inside = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    pair_kinds, _ = _repeats(pairs[inside], row[:-1][inside] if len(row) > 1 else row[:0], n)
    mean = each(lengths) / words
    spread = np.sqrt(np.maximum(each(lengths**2) / words - mean**2, 0))
    first, last = raw[starts], raw[ends - 1] if len(ends) else raw[:0]
    marked = np.isin(last, np.frombuffer(b"#$%&*|!", np.uint8))
    same = np.append(False, inside & (hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    byte = lambda chars: per(np.isin(raw, np.frombuffer(chars, np.uint8)))
    letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    letters = np.maximum(per(letter), 1)
    return np.column_stack([
        np.log1p(np.diff(rows)), mean, spread, np.log1p(np.diff(lines)), words / n_lines, per((raw >= 0x41) & (raw <= 0x5A)) / letters, each((first >= 0x41) & (first <= 0x5A)) / words,
        byte(b"0123456789") / size, per(raw >= 0x80) / size, byte(b" ") / size,
        byte(b",") / words, byte(b".") / words, byte(b"!") / words, byte(b"?") / words, byte(b"|") / words, byte(b"#") / words, byte(b"$") / words, byte(b"%") / words, byte(b"&") / words, byte(b"*") / words, byte(b"@^~_=+<>/\\") / words,
        word_kinds / words, top / words, 1 - pair_kinds / np.maximum(words - 1, 1), 1 - line_kinds / n_lines, each(lengths <= 3) / words, each(lengths <= 2) / words, each(lengths >= 12) / words, each(marked) / words, each(same) / words,
        per((raw < 32) & (raw != 10)) / size, byte(b"()[]{}") / size,
    ])


@dataclass
class Forest:
    """Complete binary trees of one depth: statistic and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        trees, inner = self.feature.shape
        depth = inner.bit_length()
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            z += self.value[t, node - inner]
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)


def bins(x: np.ndarray, n: int = BINS) -> list[np.ndarray]:
    """Thresholds of each statistic: distinct quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1], method="lower")) for c in x.T]


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosting with second-order gains; all nodes of a level are split from one histogram."""
    n, f = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0, float(y.mean()) if n else 0.0)
    cuts = bins(x)
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]).astype(np.int64)
    width = BINS
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    column = np.arange(f) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first) * (f * width))[:, None] + column + binned
            flat = cell.reshape(-1)
            shape = (count, f, width)
            G = np.bincount(flat, np.repeat(g, f), count * f * width).reshape(shape).cumsum(2)
            H = np.bincount(flat, np.repeat(h, f), count * f * width).reshape(shape).cumsum(2)
            N = np.bincount(flat, minlength=count * f * width).reshape(shape).cumsum(2)
            Gt, Ht, Nt = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
            gain = G**2 / (H + L2) + (Gt - G) ** 2 / (Ht - H + L2) - Gt**2 / (Ht + L2)
            gain = np.where((N >= LEAST) & (Nt - N >= LEAST), gain, 0).reshape(count, -1)
            best = gain.argmax(1)
            good = gain[np.arange(count), best] > 1e-6
            which, cut = best // width, best % width
            for k in np.flatnonzero(good):
                feature[t, first + k] = which[k]
                threshold[t, first + k] = cuts[which[k]][min(cut[k], len(cuts[which[k]]) - 1)]
            at = node - first
            right = good[at] & (binned[np.arange(n), which[at]] > cut[at])
            node = 2 * node + 1 + right
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        z += value[t, leaf]
    return Forest(feature, threshold, value, base)


def fit_sample(sample: DataFrame) -> Forest:
    """Fits on the rows of ``labelled_sample``."""
    width = len(STATISTICS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), lists], names=["doc_id", "label", "x"])

    got = sample.mapInArrow(extract, "doc_id bigint, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, width)
    return fit_forest(x, got.column("label").to_numpy().astype(np.float64))


def score_documents(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(statistics(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id bigint, score double")


def quality_model(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Forest:
    """Learnt from labelled rows whose crc32(doc_id) mod 4 isn't 2."""
    return fit_sample(labelled_sample(docs, labels, "quality", remainder(4) != 2, bound))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored."""
    docs, labels = read_table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, quality_model(docs, labels))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
