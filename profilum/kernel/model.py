"""Profiles and the local search models made from them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from profilum.functions.residues import AMINO, AMINO_DEGENERATE, DNA, DNA_DEGENERATE, NONRESIDUES

#: Background frequencies of amino acids in Swiss-Prot 50.8, in the order of the alphabet.
AMINO_BACKGROUND = (
    0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728,
    0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133,
)
MM, MI, MD, IM, II, DM, DD = range(7)
LN2 = float(np.log(2))


def background(alphabet: str) -> np.ndarray:
    if alphabet == "amino":
        f = np.array(AMINO_BACKGROUND)
        return f / f.sum()
    return np.full(4, 0.25)


def code_table(alphabet: str) -> np.ndarray:
    """Byte to symbol number: canonical letters first, then degenerate ones, then one number for what matches nothing; -1 for the rest."""
    canonical = AMINO if alphabet == "amino" else DNA
    degenerate = AMINO_DEGENERATE if alphabet == "amino" else DNA_DEGENERATE
    table = np.full(256, -1, np.int16)
    for i, c in enumerate([*canonical, *degenerate]):
        table[ord(c)] = table[ord(c.lower())] = i
    for c in NONRESIDUES:
        table[ord(c)] = len(canonical) + len(degenerate)
    if alphabet != "amino":
        table[ord("U")] = table[ord("u")] = DNA.index("T")
    return table


def encode(residues: str, alphabet: str) -> np.ndarray:
    """Symbol numbers of a sequence; letters outside the alphabet raise ValueError."""
    codes = code_table(alphabet)[np.frombuffer(residues.encode("latin-1", "replace"), np.uint8)]
    if (codes < 0).any():
        raise ValueError(f"not {alphabet}: {residues[int(np.argmax(codes < 0))]!r}")
    return codes


def symbol_odds(match_odds: np.ndarray, alphabet: str, bg: np.ndarray) -> np.ndarray:
    """Odds of all symbols, degenerate ones as background-weighted means, and 0 for what matches nothing."""
    canonical = AMINO if alphabet == "amino" else DNA
    degenerate = AMINO_DEGENERATE if alphabet == "amino" else DNA_DEGENERATE
    rows = [match_odds]
    for letters in degenerate.values():
        at = [canonical.index(c) for c in letters]
        w = bg[at] / bg[at].sum()
        rows.append((match_odds[:, at] @ w)[:, None])
    rows.append(np.zeros((len(match_odds), 1)))
    return np.concatenate(rows, 1)


@dataclass
class Profile:
    """Probabilities of a profile: match (M, K), insert (M + 1, K), transitions (M + 1, 7), and what its file says."""

    name: str
    alphabet: str
    match: np.ndarray
    insert: np.ndarray
    trans: np.ndarray
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)
    compo: np.ndarray | None = None
    max_length: int | None = None
    index: int = 0
    consensus: str = ""

    @property
    def length(self) -> int:
        return len(self.match)

    @classmethod
    def from_row(cls, row) -> "Profile":
        """A row of the profile table."""
        nlog = lambda m: np.exp(-np.array([[np.inf if v is None else v for v in r] for r in m], float))
        stats = {k: (row[f"stats_{k}"]["tau" if k == "forward" else "mu"], row[f"stats_{k}"]["lambda"]) for k in ("msv", "viterbi", "forward") if row[f"stats_{k}"] is not None}
        compo = None if row["compo"] is None else np.exp(-np.array(row["compo"]))
        return cls(row["name"], row["alphabet"], nlog(row["match_nlog"]), nlog(row["insert_nlog"]), nlog(row["trans_nlog"]), stats, compo, row["max_length"], row["profile_index"], row["consensus"] or "")

    def to_row(self) -> dict:
        """What ``from_row`` reads."""
        nlog = lambda m: [[None if v <= 0 else float(-np.log(v)) for v in r] for r in m]
        stats = {f"stats_{k}": {"tau" if k == "forward" else "mu": float(v[0]), "lambda": float(v[1])} for k, v in self.stats.items()}
        compo = None if self.compo is None else (-np.log(self.compo)).tolist()
        return {
            "profile_index": self.index, "name": self.name, "alphabet": self.alphabet, "model_length": self.length, "max_length": self.max_length, "consensus": self.consensus,
            "match_nlog": nlog(self.match), "insert_nlog": nlog(self.insert), "trans_nlog": nlog(self.trans), "compo": compo, **stats,
        }

    def composition(self) -> np.ndarray:
        """Mean match composition, weighted by occupancy."""
        if self.compo is not None:
            return self.compo / self.compo.sum()
        occ = occupancy(self.trans)
        return (occ[:, None] * self.match).sum(0) / occ.sum()


def occupancy(trans: np.ndarray) -> np.ndarray:
    """Probability that each match state is used."""
    out = np.empty(len(trans) - 1)
    out[0] = trans[0, MI] + trans[0, MM]
    for k in range(1, len(out)):
        out[k] = out[k - 1] * (trans[k, MM] + trans[k, MI]) + (1 - out[k - 1]) * trans[k, DM]
    return out


@dataclass
class Model:
    """A local model: match odds by symbol (S, M), entries, transitions into each node, and null and length parameters.

    Inserts emit as the background does.  ``chain`` holds the weights of 1, 2,
    4, ... steps from delete to delete.
    """

    profile: Profile
    odds: np.ndarray
    entry: np.ndarray
    mm: np.ndarray
    im: np.ndarray
    dm: np.ndarray
    mi: np.ndarray
    ii: np.ndarray
    md: np.ndarray
    dd: np.ndarray
    chain: list[tuple[int, np.ndarray]]

    @property
    def length(self) -> int:
        return len(self.entry)


def doublings(step: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(r, products of step[k - r + 1] to step[k] for k from r on), r doubling: the recurrence y[k] = x[k] + step[k] y[k - 1]
    is y[r:] += product * y[:-r] for one r after the other, its mirror image y[:-r] += product * y[r:]."""
    out, product, reach = [], np.asarray(step, float), 1
    while reach < len(step) and product[reach:].any():
        out.append((reach, product[reach:].copy()))
        product = np.concatenate([np.zeros(reach), product[reach:] * product[:-reach]])
        reach *= 2
    return out


def local_model(profile: Profile) -> Model:
    """Uniform-length local alignment: entry in proportion to occupancy, exit from any match or delete."""
    bg = background(profile.alphabet)
    m = profile.length
    occ = occupancy(profile.trans)
    entry = occ / (occ * np.arange(m, 0, -1)).sum()
    t = profile.trans
    into = lambda kind: np.concatenate([[0.0], t[1:m, kind]])  # noqa: E731  from node k - 1 to k
    own = lambda kind: np.concatenate([t[1:m, kind], [0.0]])
    md, dd = into(MD), into(DD)
    return Model(profile, np.ascontiguousarray(symbol_odds(profile.match / bg, profile.alphabet, bg).T), entry, into(MM), into(IM), into(DM), own(MI), own(II), md, dd, doublings(dd))


def null_score(n: np.ndarray | int) -> np.ndarray | float:
    """Log odds of the null model's length distribution; residues themselves cancel."""
    return n * np.log(n / (n + 1.0)) + np.log(1.0 / (n + 1.0))
