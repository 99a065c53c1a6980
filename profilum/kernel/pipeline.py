"""The filter cascade from raw sequences to scored domains."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from profilum.kernel import dp
from profilum.kernel.domains import Domain, domains_of
from profilum.kernel.model import Model, Profile, local_model

#: P-values that pass the ungapped, Viterbi and Forward filters.
F1, F2, F3 = 0.02, 1e-3, 1e-5
#: Cells (sequences x states) worked on at once.
CELLS = 1 << 16


@dataclass
class Hit:
    """A sequence (by its number in the batch) that passed the filters."""

    number: int
    score: float
    bias: float
    lnp: float
    domains: list[Domain]


def gumbel_p(score: np.ndarray, mu: float, lam: float) -> np.ndarray:
    return -np.expm1(-np.exp(np.minimum(-lam * (score - mu), 700.0)))


def tail_p(score: np.ndarray, tau: float, lam: float) -> np.ndarray:
    return np.exp(np.minimum(-lam * (score - tau), 0.0))


def search_batch(model: Model, codes: list[np.ndarray], bias_filter: bool = True) -> list[Hit]:
    """Hits of one profile among sequences; those of similar length are worked on together."""
    hits: list[Hit] = []
    order = np.argsort([len(c) for c in codes], kind="stable")
    step = max(1, CELLS // model.length)
    stats = model.profile.stats
    for at in range(0, len(order), step):
        chosen = [int(i) for i in order[at : at + step] if len(codes[i])]
        if not chosen:
            continue
        x, lengths = dp.pad([codes[i] for i in chosen])
        raw = dp.msv(model, x, lengths)
        keep = gumbel_p(dp.bits(raw, lengths), *stats["msv"]) <= F1
        if keep.any() and bias_filter:
            at_ = np.flatnonzero(keep)
            bias = dp.composition_filter(model, x[at_], lengths[at_])
            keep[at_] = gumbel_p(dp.bits(raw[at_], lengths[at_], bias), *stats["msv"]) <= F1
        at_ = np.flatnonzero(keep)
        if len(at_):
            at_ = at_[gumbel_p(dp.bits(dp.viterbi(model, x[at_], lengths[at_]), lengths[at_]), *stats["viterbi"]) <= F2]
        if len(at_):
            at_ = at_[tail_p(dp.bits(dp.forward(model, x[at_], lengths[at_]), lengths[at_]), *stats["forward"]) <= F3]
        for i in at_:
            score, bias, domains = domains_of(model, codes[chosen[i]])
            if domains:
                tau, lam = stats["forward"]
                hits.append(Hit(chosen[i], score, bias, min(0.0, -lam * (score - tau)), domains))
    return hits


_MODELS: dict[tuple, Model] = {}


def model_of(profile: Profile, key: tuple | None = None) -> Model:
    """The local model of a profile; kept by key within a process."""
    if key is None:
        return local_model(profile)
    if key not in _MODELS:
        if len(_MODELS) > 4096:
            _MODELS.clear()
        _MODELS[key] = local_model(profile)
    return _MODELS[key]
