"""The kernel against explicit enumeration of all paths, and statistics of its scores."""

from functools import lru_cache

import numpy as np
import pytest

from profilum.functions.residues import AMINO
from profilum.kernel import build, dp, model, pipeline


def tiny(m, seed):
    rng = np.random.default_rng(seed)
    bg = model.background("amino")
    return model.local_model(model.Profile("t", "amino", rng.dirichlet(np.ones(20), m), np.tile(bg, (m + 1, 1)), build._transitions(m, 0.1, 0.3)))


def enumerate_paths(own, x, add, multihit=True):
    """Total (or best) weight of all paths, by recursion over states as the model defines them."""
    n, size = len(x), own.length
    move = (3.0 if multihit else 2.0) / (n + (3.0 if multihit else 2.0))
    stay, again = 1 - move, 0.5 if multihit else 0.0

    @lru_cache(None)
    def rest(state, k, t):
        emit = lambda j: own.odds[x[t]][j] * rest("M", j, t + 1)
        more = t < n
        if state in "NJ":
            return add([stay * rest(state, 0, t + 1) if more else 0, move * add([own.entry[j] * emit(j) for j in range(size)]) if more else 0])
        if state == "C":
            return add([stay * rest("C", 0, t + 1) if more else 0, move * (t == n)])
        if state == "E":
            return add([again * rest("J", 0, t), (1 - again) * rest("C", 0, t)])
        out = [rest("E", 0, t)] if state in "MD" else []
        if state in "MI" and more:
            out.append((own.mi if state == "M" else own.ii)[k] * rest("I", k, t + 1))
        if k + 1 < size:
            if more:
                out.append({"M": own.mm, "I": own.im, "D": own.dm}[state][k + 1] * emit(k + 1))
            if state in "MD":
                out.append((own.md if state == "M" else own.dd)[k + 1] * rest("D", k + 1, t))
        return add(out) if out else 0

    return np.log(rest("N", 0, 0))


@pytest.mark.parametrize("m", [1, 2, 3, 4])
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_recurrences_equal_all_paths(m, n):
    own, x = tiny(m, m), np.random.default_rng(n).integers(0, 20, n).astype(np.int16)
    lengths = np.array([n])
    assert abs(dp.forward(own, x[None], lengths)[0] - enumerate_paths(own, tuple(x), sum)) < 1e-9
    assert abs(dp.forward(own, x[None], lengths, multihit=False)[0] - enumerate_paths(own, tuple(x), sum, False)) < 1e-9
    assert abs(dp.viterbi(own, x[None], lengths)[0] - enumerate_paths(own, tuple(x), lambda v: max(v, default=0))) < 1e-9
    p = dp.Posterior(own, x)
    assert -1e-9 <= p.inside.min() and p.inside.max() <= 1 + 1e-9 and abs(p.begin.sum() - p.end.sum()) < 1e-9


def test_batches_do_not_change_scores():
    rng = np.random.default_rng(3)
    own = model.local_model(build.from_sequence("q", "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"))
    codes = [rng.integers(0, 20, n).astype(np.int16) for n in rng.integers(5, 90, 30)]
    x, lengths = dp.pad(codes)
    for f in (dp.forward, dp.viterbi, dp.msv):
        alone = [f(own, c[None], np.array([len(c)]))[0] for c in codes]
        assert np.allclose(f(own, x, lengths), alone, atol=1e-4)
    assert (dp.forward(own, x, lengths) >= dp.viterbi(own, x, lengths) - 1e-9).all()


@pytest.mark.parametrize("m", [1, 2, 7, 40])
def test_chains_of_deletes_equal_steps_one_by_one(m):
    own, match = tiny(m, 4), np.random.default_rng(m).random((3, m))
    plain = np.zeros_like(match)
    for k in range(1, m):
        plain[:, k] = match[:, k - 1] * own.md[k] + plain[:, k - 1] * own.dd[k]
    assert np.allclose(dp._chain(own, match), plain, rtol=1e-12)
    back = match[0].copy()
    for k in range(m - 2, -1, -1):
        back[k] += back[k + 1] * own.dd[k + 1]
    assert np.allclose(dp._enter(own, np.zeros(m), match[0], 0.0)[1], back, rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 9, 64, 65])
def test_posteriors_do_not_depend_on_the_rows_kept(monkeypatch, n):
    own, x = tiny(12, 4), np.random.default_rng(n).integers(0, 20, n).astype(np.int16)
    whole = dp.Posterior(own, x)
    monkeypatch.setattr(dp, "KEPT_CELLS", 1)
    blocks, lean = dp.Posterior(own, x), dp.Posterior(own, x, states=False)
    for name in ("score", "begin", "end", "inside", "match", "insert"):
        assert np.allclose(getattr(whole, name), getattr(blocks, name), atol=1e-12)
    assert lean.match is None and np.array_equal(lean.inside, blocks.inside) and np.array_equal(lean.begin, blocks.begin)


def test_pvalues_of_random_sequences_are_uniform_in_the_tail():
    profile = build.from_sequence("q", "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQ")
    own, rng = model.local_model(profile), np.random.default_rng(9)
    x = rng.choice(20, size=(3000, 100), p=model.background("amino")).astype(np.int16)
    lengths = np.full(3000, 100)
    for score, key, p in ((dp.msv, "msv", pipeline.gumbel_p), (dp.viterbi, "viterbi", pipeline.gumbel_p), (dp.forward, "forward", pipeline.tail_p)):
        values = p(dp.bits(score(own, x, lengths), lengths), *profile.stats[key])
        assert 0.004 < (values < 0.01).mean() < 0.025


def test_planted_domains_are_found_and_calibration_repeats():
    q = build.from_sequence("q", "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQTLGQHDFSAGEGLYTHMKALRPDED")
    assert q.stats == build.from_sequence("q", q.consensus).stats
    rng = np.random.default_rng(2)
    noise = lambda n: "".join(rng.choice(list(AMINO), n, p=model.background("amino")))
    one, two = noise(60) + q.consensus[10:90] + noise(50), noise(30) + q.consensus + noise(80) + q.consensus[20:] + noise(10)
    hits = pipeline.search_batch(model.local_model(q), [model.encode(s, "amino") for s in (noise(200), one, two, q.consensus + "*")])
    assert [h.number for h in hits] in ([3, 1, 2], [1, 2, 3], [1, 3, 2])
    by = {h.number: h for h in hits}
    assert len(by[1].domains) == 1 and len(by[2].domains) == 2
    d = by[1].domains[0]
    assert abs(d.ali_from - 61) <= 6 and abs(d.ali_to - 140) <= 6 and abs(d.hmm_from - 11) <= 6
    assert by[3].domains[0].ali_to == len(q.consensus)


def test_alphabets():
    assert model.encode("acdX*", "amino").tolist()[:3] == [0, 1, 2]
    assert model.encode("ACGU", "dna").tolist() == model.encode("ACGT", "rna").tolist()
    with pytest.raises(ValueError):
        model.encode("AC9", "amino")
