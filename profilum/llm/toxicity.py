"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings that labelled toxic
documents share) and patterns; each votes toxic, votes clean or abstains.  A
generative label model estimates by expectation-maximisation how each voter
votes on toxic and on clean documents, and how far voters repeat each other
given the label; correlated voters share their weight.  A linear classifier
over hashed words and word beginnings is then trained on the posterior labels,
so it also scores documents that no voter knows.

Everything is fitted on a bounded sample of labelled rows
(``labels.SAMPLE_ROWS``); texts are the only input of a score.  ``Settings``
holds what bounds the model: how many voters and features it has at most, and
how much one feature counts in one text.  Each may be None, for no bound.

Cases: null or empty texts get the score of a document without features;
without labelled rows of both classes every score is the share of toxic ones
(0 without any); equal texts get equal scores; extra columns are ignored.
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
from profilum.llm.shared import release
from profilum.sources.tables import read_table

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Occurrences in 100 words from which an entry may vote.
DENSITIES = (0.0, 0.1, 0.3, 1.0)
#: Rows of votes worked on at once.
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Settings:
    """Parameters of a fit."""

    #: Documents of the sample that a lexicon entry or feature must occur in.
    support: int = 4
    #: Share of its votes that must be right for a lexicon entry to become a voter.
    precision: float = 0.8
    #: Voters at most: the lexicon entries that tell the classes apart best (by Welch's t) come first.
    voters: int | None = 300
    #: Features of the linear classifier at most, in the same order.
    features: int | None = 3000
    #: Occurrences in 100 words beyond which a feature counts no further, so that one repeated word does not decide alone.
    cut: float | None = 3.0


DEFAULT = Settings()


def features(column: pa.Array, cut: float | None = DEFAULT.cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of each text (flat, distinct within a text), their occurrences in 100 words, and offsets."""
    lowered = pa.array([None if t is None else t.lower() for t in column.to_pylist()], pa.string())
    raw, starts, ends, rows, hashes = X.split_words(lowered, X.ALNUM, seed=5)
    doc = X.row_of(rows)
    parts, owners = [hashes], [doc]
    lengths = ends - starts
    for k in PREFIXES:
        longer = np.flatnonzero(lengths > k)
        head = X.word_hashes(raw, starts[longer], starts[longer] + k, seed=5)
        parts.append(X.mix64(head + X.U64(k)))
        owners.append(doc[longer])
    key = (np.concatenate(owners).astype(np.int64) << BITS) | (np.concatenate(parts) >> X.U64(64 - BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    density = 100.0 * count / np.diff(rows)[key >> BITS]
    density = density if cut is None else np.minimum(density, cut)
    return (key & (1 << BITS) - 1).astype(np.int32), density.astype(np.float32), np.searchsorted(key, np.arange(len(column) + 1, dtype=np.int64) << BITS)


def patterns(column: pa.Array) -> np.ndarray:
    """Per text: share of upper case among letters, exclamation marks a word, symbols a word."""
    raw, offsets = X.utf8(column)
    upper = (raw >= 0x41) & (raw <= 0x5A)
    lower = (raw >= 0x61) & (raw <= 0x7A)
    space = ~X.NOT_SPACE[raw]
    symbol = np.isin(raw, np.frombuffer(b"#$%&*|~^", np.uint8))
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])
    words = total(space) + 1
    return np.column_stack([total(upper) / np.maximum(total(upper) + total(lower), 1), total(raw == 0x21) / words, total(symbol) / words])


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of label 1 for each row of votes (1, -1, 0: abstain), and the voters' parameters.

    The parameters are the probabilities of each vote given each label
    (``rates``: voter, vote, label) and ``share``, the weight that a voter
    keeps beside those it is correlated with given the label.
    """
    n, m = votes.shape

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, n, BLOCK_ROWS):
            yield slice(at, at + BLOCK_ROWS), votes[at : at + BLOCK_ROWS].astype(np.float32)

    def alike(weight: np.ndarray | None) -> np.ndarray:
        """Correlations of the voters, over weighted rows."""
        w = np.ones(n, np.float32) if weight is None else (weight + 1e-9).astype(np.float32)
        mean = sum(w[own] @ signed for own, signed in blocks()) / w.sum()
        both = np.zeros((m, m))
        for own, signed in blocks():
            signed -= mean
            signed *= np.sqrt(w[own])[:, None]
            both += signed.T @ signed
        spread = np.sqrt(both.diagonal()) + 1e-9
        return np.abs(both) / np.outer(spread, spread)

    # voters that nearly repeat each other count as one from the start
    share = 1 / np.maximum((alike(None) > 0.9).sum(1), 1)
    share32 = share.astype(np.float32)
    q = np.concatenate([np.where((signed > 0) @ share32 > (signed < 0) @ share32, 0.9, 0.1) for _, signed in blocks()])
    rates = np.zeros((m, 3, 2))
    for step in range(rounds):
        weights = np.stack([1 - q, q]).astype(np.float32)
        votes_for, against = np.zeros((2, m)), np.zeros((2, m))
        for own, signed in blocks():
            votes_for += weights[:, own] @ (signed > 0).astype(np.float32)
            against += weights[:, own] @ (signed < 0).astype(np.float32)
        for y in (0, 1):
            count = np.stack([votes_for[y], against[y], np.maximum(weights[y].sum() - votes_for[y] - against[y], 0)], 1) + np.array([0.01, 0.01, 0.1])
            rates[:, :, y] = count / count.sum(1, keepdims=True)
        if step % 10 == 5:
            mass = np.maximum(alike(1 - q), alike(q)) * votes.any(0)
            np.fill_diagonal(mass, 1)
            share = 1 / np.where(mass > 0.3, mass, 0).sum(1)
        odds = np.log(rates[:, :, 1] / rates[:, :, 0]) * share[:, None]
        odds[:, 2] = np.clip(odds[:, 2], -0.02, 0.02)  # silence says little
        said = [(odds[:, k] - odds[:, 2]).astype(np.float32) for k in (0, 1)]
        logit = np.log(prior / (1 - prior)) + odds[:, 2].sum() + np.concatenate([(signed > 0) @ said[0] + (signed < 0) @ said[1] for _, signed in blocks()])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-5 and step > 12:
            q = new
            break
        q = new
    return q, {"rates": rates, "share": share}


def fit_linear(flat: np.ndarray, value: np.ndarray, offsets: np.ndarray, target: np.ndarray, n_features: int, rounds: int = 300, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression with soft targets by Adam on the whole sample; the last weight is the bias."""
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    row = X.row_of(offsets)
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    balance /= balance.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[flat] * value, len(target)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance
        g = np.bincount(flat, error[row] * value, n_features + 1) + l2 * w
        g[-1] = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


@dataclass
class Model:
    """Weights of hashed features, a bias, and a constant score used instead if there was nothing to learn from."""

    weights: np.ndarray
    bias: float
    constant: float | None = None
    cut: float | None = DEFAULT.cut

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        flat, value, offsets = features(column, self.cut)
        z = np.bincount(X.row_of(offsets), self.weights[flat] * value, len(column)) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)


#: Feature occurrences worked on at once while fitting, and partitions of the sample.
PIECE, FIT_PARTS = 1 << 20, 16


class Strength:
    """Sums over a stream of texts from which Welch's t of each feature's density in toxic against clean documents follows."""

    def __init__(self) -> None:
        self.seen, self.mean, self.square = (np.zeros((2, 1 << BITS)) for _ in range(3))
        self.n = [0, 0]
        self.held: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.size = 0

    def add(self, flat: np.ndarray, value: np.ndarray, label: int) -> None:
        self.n[label] += 1
        self.held.append((flat, value, label))
        self.size += len(flat)
        if self.size > PIECE:
            self.flush()

    def flush(self) -> None:
        for y in (0, 1):
            own = [h for h in self.held if h[2] == y]
            if own:
                f, v = np.concatenate([h[0] for h in own]), np.concatenate([h[1] for h in own])
                for total, w in ((self.seen, None), (self.mean, v), (self.square, v**2)):
                    total[y] += np.bincount(f, w, 1 << BITS)
        self.held, self.size = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """t of each feature, and in how many toxic and clean documents it occurs."""
        self.flush()
        spread = np.zeros(1 << BITS)
        mean = [m / max(n, 1) for m, n in zip(self.mean, self.n)]
        for y in (0, 1):
            n = max(self.n[y], 1)
            spread += (self.square[y] / n - mean[y] ** 2 + 1.0 / n) / n
        return (mean[1] - mean[0]) / np.sqrt(spread), self.seen[1], self.seen[0]


def choose_features(told: Strength, settings: Settings = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon's candidates, and the features of the classifier."""
    t, in_toxic, in_clean = told.result()
    order = np.argsort(-np.where(in_toxic >= min(settings.support, max(1, told.n[1] // 4)), t, 0), kind="stable")
    # twice as many candidates as voters, as not all are precise enough
    lexicon = order if settings.voters is None else order[: settings.voters * 2]
    worth = np.abs(t) * ((in_toxic + in_clean) >= settings.support)
    chosen = np.argsort(-worth, kind="stable")[: settings.features]
    return lexicon[t[lexicon] > 1.5], chosen[worth[chosen] > 1]


def fit(flat: np.ndarray, value: np.ndarray, offsets: np.ndarray, extra: np.ndarray, label: np.ndarray, lexicon: np.ndarray, chosen: np.ndarray, settings: Settings = DEFAULT) -> Model:
    """The classifier of a labelled sample: its chosen features with densities, patterns and labels."""
    n = len(label)
    if n == 0 or label.min() == label.max():
        return Model(np.zeros(1 << BITS), 0.0, float(label.mean()) if n else 0.0)
    prior = float(label.mean())
    row = X.row_of(offsets)
    number = np.full(1 << BITS, -1)
    number[lexicon] = np.arange(len(lexicon))
    hit = np.flatnonzero(number[flat] >= 0)
    who, entry, much, toxic = row[hit], number[flat[hit]], value[hit], label[row[hit]] == 1
    best, cut = np.zeros(len(lexicon)), np.zeros(len(lexicon))
    for density in DENSITIES:
        strong = much >= density
        good = np.bincount(entry[strong & toxic], minlength=len(lexicon))
        every = np.bincount(entry[strong], minlength=len(lexicon))
        sure = np.where(good >= 2, (good + 1) / (every + 2), 0)
        better = sure > best
        best[better], cut[better] = sure[better], density
    used = np.flatnonzero(best >= settings.precision)[: settings.voters]
    column = np.full(len(lexicon), -1)
    column[used] = np.arange(len(used))
    votes = np.zeros((n, len(used) + 3 + extra.shape[1]), np.int8)
    voted = (column[entry] >= 0) & (much >= cut[entry])
    votes[who[voted], column[entry[voted]]] = 1
    found = (votes > 0).sum(1)
    total = np.bincount(who, much * (column[entry] >= 0), n)
    base = len(used)
    votes[:, base] = np.where(found >= 3, 1, 0)
    votes[:, base + 1] = np.where(found == 0, -1, 0)
    votes[:, base + 2] = np.where(total >= 1.0, 1, np.where(total < 0.2, -1, 0))
    for k in range(extra.shape[1]):
        high = extra[:, k] > np.quantile(extra[:, k], 0.98)
        side = 1 if high.any() and label[high].mean() > 3 * prior else -1 if high.any() and label[high].mean() < prior / 3 else 0
        votes[high, base + 3 + k] = side
    posterior, _ = label_model(votes, prior)
    number[:] = -1
    number[chosen] = np.arange(len(chosen))
    keep = number[flat] >= 0
    short = np.concatenate([[0], np.cumsum(keep)])[offsets]
    w = fit_linear(number[flat[keep]], value[keep], short, posterior, len(chosen))
    weights = np.zeros(1 << BITS)
    weights[chosen] = w[:-1]
    return Model(weights, float(w[-1]), cut=settings.cut)


def fit_sample(sample: DataFrame, settings: Settings = DEFAULT) -> Model:
    """Fits on the rows of ``labelled_sample``: one pass sums up all features, a second brings the chosen ones to the driver."""
    # the few sampled texts are brought together first: an iterator takes one partition after another, each in a job of its own
    near = sample.repartition(FIT_PARTS, "doc_id").coalesce(FIT_PARTS).sortWithinPartitions("doc_id")

    def rows(wanted):
        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in X.slices(batches):
                flat, value, offsets = features(batch.column(1), settings.cut)
                if wanted is not None:
                    kept = wanted.value[flat]
                    flat, value, offsets = flat[kept], value[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), cut(flat), cut(value), pa.array([e.tobytes() for e in patterns(batch.column(1))], pa.binary())], names=["label", "features", "densities", "extra"])

        for r in near.mapInArrow(extract, "label int, features binary, densities binary, extra binary").toLocalIterator(prefetchPartitions=True):
            yield np.frombuffer(r["features"], np.int32), np.frombuffer(r["densities"], np.float32), int(r["label"] > 0), np.frombuffer(r["extra"])

    told = Strength()
    for flat, value, label, _ in rows(None):
        told.add(flat, value, label)
    lexicon, chosen = choose_features(told, settings)
    del told
    release()
    wanted = np.zeros(1 << BITS, bool)
    wanted[lexicon] = wanted[chosen] = True
    flats, values, labels, extras = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [], []
    for flat, value, label, extra in rows(sample.sparkSession.sparkContext.broadcast(wanted)):
        flats.append(flat)
        values.append(value)
        labels.append(label)
        extras.append(extra)
    offsets = np.cumsum([len(f) for f in flats], dtype=np.int64)
    flat, value = np.concatenate(flats), np.concatenate(values)
    del flats, values
    model = fit(flat, value, offsets, np.array(extras).reshape(-1, 3), np.array(labels, np.int64), lexicon, chosen, settings)
    del flat, value, extras
    release()
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text_col):
            yield batch.filter(pa.array(sent.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def toxicity_model(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, settings: Settings = DEFAULT) -> Model:
    """Learnt from labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    return fit_sample(labelled_sample(docs, labels, "toxic", remainder(5) != 0, bound), settings)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored."""
    docs, labels = read_table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, toxicity_model(docs, labels))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
