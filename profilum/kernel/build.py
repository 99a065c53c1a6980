"""Profiles from single sequences and from alignments, and their calibration."""

from __future__ import annotations

import functools

import numpy as np

from profilum.functions.residues import AMINO, DNA
from profilum.kernel import dp
from profilum.kernel.model import LN2, Profile, background, local_model, occupancy

#: BLOSUM62, rows in the order of the amino alphabet, each up to its diagonal.
BLOSUM62 = """
4
0 9
-2 -3 6
-1 -4 2 5
-2 -2 -3 -3 6
0 -3 -1 -2 -3 6
-2 -3 -1 0 -1 -2 8
-1 -1 -3 -3 0 -4 -3 4
-1 -3 -1 1 -3 -2 -1 -3 5
-1 -1 -4 -3 0 -4 -3 2 -2 4
-1 -1 -3 -2 0 -3 -2 1 -1 2 5
-2 -3 1 0 -3 0 1 -3 0 -3 -2 6
-1 -3 -1 -1 -4 -2 -2 -3 -1 -3 -2 -2 7
-1 -3 0 2 -3 -2 0 -3 1 -2 0 0 -1 5
-1 -3 -2 0 -3 -2 0 -3 2 -2 -1 0 -2 1 5
1 -1 0 0 -2 0 -1 -2 0 -2 -1 1 -1 0 -1 4
0 -1 -1 -1 -2 -2 -2 -1 -1 -1 -1 0 -1 -1 -1 1 5
0 -1 -3 -2 -1 -3 -3 3 -2 1 1 -3 -2 -2 -3 -2 0 4
-3 -2 -4 -3 1 -2 -2 -3 -3 -2 -1 -4 -4 -2 -3 -3 -2 -3 11
-2 -2 -3 -2 3 -3 2 -1 -2 -1 -1 -2 -3 -1 -2 -2 -2 -1 2 7
"""
GAP_OPEN, GAP_EXTEND = 0.02, 0.4
#: Nucleotides: scores of match and mismatch, from which conditional probabilities follow.
DNA_SCORES = (3.0, -4.0)
#: Information that the effective number of sequences aims at, in bits a position, and the weight of pseudocounts.
TARGET_BITS, PSEUDO = 0.59, 10.0


@functools.cache
def conditional(alphabet: str) -> np.ndarray:
    """P(b | a) of the substitution scores against the background."""
    bg = background(alphabet)
    if alphabet == "amino":
        s = np.zeros((20, 20))
        for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
            s[i, : i + 1] = s[: i + 1, i] = [int(v) for v in line.split()]
    else:
        s = np.full((4, 4), DNA_SCORES[1])
        np.fill_diagonal(s, DNA_SCORES[0])
    low, high = 1e-4, 2.0
    for _ in range(80):
        mid = (low + high) / 2
        if (np.outer(bg, bg) * np.exp(mid * s)).sum() > 1:
            high = mid
        else:
            low = mid
    joint = np.outer(bg, bg) * np.exp(low * s)
    return joint / joint.sum(1, keepdims=True)


def _transitions(length: int, opening: float, extending: float) -> np.ndarray:
    t = np.tile([1 - 2 * opening, opening, opening, 1 - extending, extending, 1 - extending, extending], (length + 1, 1))
    t[0, 5:] = [1.0, 0.0]
    t[length] = [1 - opening, opening, 0.0, 1 - extending, extending, 1.0, 0.0]
    return t


def uncalibrated(name: str, residues: str, alphabet: str = "amino", opening: float = GAP_OPEN, extending: float = GAP_EXTEND, index: int = 0) -> Profile:
    """A profile that scores as the substitution matrix and gap probabilities do; degenerate residues count as the background."""
    letters = AMINO if alphabet == "amino" else DNA
    p, bg = conditional(alphabet), background(alphabet)
    kept = [c for c in residues.upper().replace("U", "T" if alphabet != "amino" else "U") if c.isalpha()]
    if not kept:
        raise ValueError(f"{name}: no residues")
    match = np.array([p[letters.index(c)] if c in letters else bg for c in kept])
    return Profile(name, "amino" if alphabet == "amino" else "dna", match, np.tile(bg, (len(match) + 1, 1)), _transitions(len(match), opening, extending), index=index, consensus="".join(kept))


def from_sequence(name: str, residues: str, alphabet: str = "amino", opening: float = GAP_OPEN, extending: float = GAP_EXTEND, index: int = 0) -> Profile:
    """The same with score statistics."""
    return calibrate(uncalibrated(name, residues, alphabet, opening, extending, index))


def mean_entropy(profile: Profile) -> float:
    """Relative entropy of match states in bits a position."""
    bg = background(profile.alphabet)
    p = np.maximum(profile.match, 1e-12)
    return float((p * np.log2(p / bg)).sum(1).mean())


def calibrate(profile: Profile, n: int = 200, length: int = 100, seed: int = 42) -> Profile:
    """Fits locations of score distributions on random sequences of a fixed seed; lambda follows from length and entropy."""
    rng = np.random.default_rng(seed)
    bg = background(profile.alphabet)
    x = rng.choice(len(bg), size=(n, length), p=bg).astype(np.int16)
    lengths = np.full(n, length)
    model = local_model(profile)
    lam = LN2 + 1.44 / (profile.length * max(mean_entropy(profile), 1e-3))
    mu = lambda s: float(-np.log(np.exp(-lam * s).mean()) / lam)  # noqa: E731  maximum likelihood for a known lambda
    f = dp.bits(dp.forward(model, x, lengths), lengths)
    tail = 0.04
    # where the Gumbel of the scores leaves the tail mass, moved back along the exponential
    gumbel_mu, gumbel_lam = _gumbel(f)
    quantile = gumbel_mu - np.log(-np.log(1 - tail)) / gumbel_lam
    profile.stats = {"msv": (mu(dp.bits(dp.msv(model, x, lengths), lengths)), lam), "viterbi": (mu(dp.bits(dp.viterbi(model, x, lengths), lengths)), lam), "forward": (float(quantile + np.log(tail) / lam), lam)}
    return profile


def _gumbel(s: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood location and scale by Newton steps."""
    lam = np.pi / (s.std() * np.sqrt(6) + 1e-9)
    for _ in range(100):
        e = np.exp(-lam * (s - s.min()))
        a, b, c = e.sum(), (s * e).sum(), (s * s * e).sum()
        f = 1 / lam - s.mean() + b / a
        df = (b / a) ** 2 - c / a - 1 / lam**2
        step = f / df
        lam = lam / 2 if lam - step <= 0 else lam - step
        if abs(step) < 1e-9:
            break
    return float(-np.log(np.exp(-lam * s).mean()) / lam), float(lam)


def row_weights(rows: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """Position-based weights of aligned rows (symbols, ``gap`` and above for none), from the counts of symbols in all rows' columns."""
    kinds = (counts > 0).sum(1)
    padded = np.concatenate([counts, np.ones((len(counts), 1))], 1)
    seen = rows < gap
    own = padded[np.arange(rows.shape[1]), np.minimum(rows, gap)]
    share = np.where(seen, 1 / np.maximum(kinds * own, 1), 0)
    return share.sum(1) / np.maximum(seen.sum(1), 1)


def from_counts(query: Profile, counts: np.ndarray, steps: np.ndarray, weight: float, n: int) -> Profile:
    """A profile from weighted counts of symbols and transitions in the columns of ``query``.

    weight: the sum of the weights; n: how many rows.  Counts are scaled to an
    effective number of sequences at which the profile holds TARGET_BITS a
    position (all rows, if it never does), and mixed with substitution
    pseudocounts; the gap parameters of single sequences are the prior of transitions.
    """
    alphabet = query.alphabet
    bg, p = background(alphabet), conditional(alphabet)
    m = query.length
    counts, steps = counts * n / weight, steps * n / weight

    def mixed(scale: float) -> np.ndarray:
        c = counts * scale
        total = c.sum(1, keepdims=True)
        f = np.where(total > 1e-9, c / np.maximum(total, 1e-9), query.match)
        return (c + PSEUDO * (f @ p)) / (total + PSEUDO)

    low, high = 0.0, 1.0
    entropy = lambda match: float((match * np.log2(match / bg)).sum(1).mean())
    if entropy(mixed(1.0)) > TARGET_BITS:
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mixed(mid)) < TARGET_BITS else (low, mid)
    trans = _transitions(m, GAP_OPEN, GAP_EXTEND) * 20.0 + steps * high
    for part in (slice(0, 3), slice(3, 5), slice(5, 7)):
        trans[:, part] /= trans[:, part].sum(1, keepdims=True)
    trans[0, 5:], trans[m, 2], trans[m, 5:] = [1.0, 0.0], 0.0, [1.0, 0.0]
    trans[m, :2] /= trans[m, :2].sum()
    return calibrate(Profile(query.name, alphabet, mixed(high), np.tile(bg, (m + 1, 1)), trans, max_length=query.max_length, index=query.index, consensus=query.consensus))


def reach(profile: Profile, tail: float = 1e-7) -> int:
    """A length that alignments to the profile only exceed with probability ``tail``, by the mean and spread of insert lengths."""
    if profile.max_length:
        return int(profile.max_length)
    occ = occupancy(profile.trans)
    opens = float((profile.trans[1:-1, 1] * occ[:-1]).sum()) if profile.length > 1 else 0.0
    extends = float(profile.trans[1:-1, 4].mean()) if profile.length > 1 else 0.0
    mean = opens / max(1 - extends, 1e-3)
    spread = np.sqrt(mean * (1 + extends) / max(1 - extends, 1e-3)) + 1
    return int(profile.length + mean + spread * np.sqrt(2 * np.log(1 / tail)))
