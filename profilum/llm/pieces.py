"""A sentencepiece vocabulary as arrays: characters, a trie, and where pieces can never cross."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from profilum.llm import text as X

SPACE = 0x2581
UNKNOWN = -2


def default_model() -> str:
    """The public 32k piece model, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class HashMap:
    """Fixed map of 64-bit keys to int64 values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.shift = X.U64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, X.U64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys, values = keys.astype(X.U64), values.astype(np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[at[left]] < 0
            mine = np.unique(at[left[free]], return_index=True)
            put = left[free][mine[1]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[~np.isin(left, put)]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * X.U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for others."""
        keys = keys.astype(X.U64)
        at = self._slot(keys)
        out = self.values[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out


def _check(sp, path: str) -> None:
    """Only BPE models (their scores are places of merges, so whole numbers) that leave texts as they are can be counted this way."""
    scores = [sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(s != int(s) or s > 0 for s in scores):
        raise ValueError(f"{path} is not a BPE model")
    if any(sp.decode(sp.encode(t)) != t for t in (" a  b ", "\ufb01\uff11\u00a0x\n\t")):
        raise ValueError(f"{path} changes texts before it cuts them")


class Pieces:
    """Pieces of a model that text can become; characters are numbered from 1, others are 0."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        _check(sp, path)
        self.size = n
        self.bytes = np.full(256, -1, np.int64)
        kept: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                kept.append((piece, i, sp.get_score(i)))
        self.text = {i: p for p, i, _ in kept}
        self.by_text = {p: i for p, i, _ in kept}
        self.score = np.full(n, -np.inf)
        for _, i, s in kept:
            self.score[i] = s
        chars = sorted({c for p, _, _ in kept for c in p})
        self.char = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.char[ord(c)] = k
        self.char[0x20] = self.char[SPACE]
        #: the same for texts in which a written U+2581 must not become a space
        self.plain = self.char.copy()
        self.plain[SPACE] = 0
        self.n_chars = len(chars) + 1
        self.single = np.full(self.n_chars, UNKNOWN, np.int64)
        joined = np.zeros((self.n_chars, self.n_chars), bool)
        states, nodes = {"": 0}, [-1]
        keys, values = [], []
        for p, i, _ in kept:
            ids = self.char[[ord(c) for c in p]]
            if len(p) == 1:
                self.single[ids[0]] = i
            joined[ids[:-1], ids[1:]] = True
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(nodes)
                    nodes.append(-1)
                    keys.append(states[p[: k - 1]] * self.n_chars + int(ids[k - 1]))
                    values.append(states[p[:k]])
            nodes[states[p]] = i
        self.joined = joined
        self.node = np.array(nodes, np.int64)
        self.next = HashMap(np.array(keys, X.U64), np.array(values, np.int64))
        self.longest = max((len(p) for p, _, _ in kept), default=0)

    def edges(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that stand in the text: start, length, id.  room: characters up to the segment's end."""
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        starts, lengths, ids = [], [], []
        for k in range(self.longest):
            fits = room[at] > k
            at, state = at[fits], state[fits]
            state = self.next.get(state * self.n_chars + chars[at + k])
            live = state >= 0
            at, state = at[live], state[live]
            if not len(at):
                break
            end = self.node[state]
            real = end >= 0
            starts.append(at[real])
            lengths.append(np.full(int(real.sum()), k + 1))
            ids.append(end[real])
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)

    def segments(self, texts: list[str], prefix: bool = True, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts (a space before each that isn't empty), segment starts, row offsets in code points, and in segments.

        No piece stands across two segments, so each is encoded by itself.
        With ``plain`` a written U+2581 is a character without a piece.
        """
        if prefix:
            texts = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        chars = (self.plain if plain else self.char)[points]
        cut = np.ones(len(points), bool)
        if len(points):
            cut[1:] = ~self.joined[chars[:-1], chars[1:]]
            cut[rows[:-1][rows[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        return points, starts, rows, np.searchsorted(starts, rows)


@functools.cache
def pieces(path: str) -> Pieces:
    """The vocabulary at a path; loaded once in a process."""
    return Pieces(path)


def segment_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's code points, a space as its visible form."""
    if not len(starts):
        return np.zeros(0, X.U64)
    lengths = np.diff(np.append(starts, len(points)))
    place = np.arange(len(points), dtype=np.int64) - np.repeat(starts, lengths)
    seen = np.where(points == 0x20, np.uint32(SPACE), points).astype(X.U64) + X.U64(1)
    seen *= X._byte_multipliers(int(lengths.max()), 3)[place]
    return X.mix64(np.add.reduceat(seen, starts) + lengths.astype(X.U64) * X.U64(0xD6E8FEB86659FD93))


def distinct_segments(points: np.ndarray, starts: np.ndarray, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct segments among ``which``: their code points, offsets, and for each of ``which`` its number and the hashes of the distinct ones."""
    _, first, number = np.unique(hashes[which], return_index=True, return_inverse=True)
    chosen = which[first]
    lengths = np.diff(np.append(starts, len(points)))[chosen]
    return points[X.expand(starts[chosen], lengths)], np.concatenate([[0], np.cumsum(lengths)]), number, hashes[chosen]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]
