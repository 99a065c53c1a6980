"""Token counts and sampled segmentations."""

import collections
import math
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from profilum.llm import pieces, sampling, token_counts

ALPHABET = "ab eéßñ the ing\n\t.,!#$|0123<s>▁  \x00ﬁ１中文字😀한"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_counts_of_all_prefixes(library, text):
    counter = token_counts.counter(pieces.default_model())
    assert counter.all_prefixes(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]


def test_steps_of_many_texts_sum_up_to_their_prefix_counts(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "tion", "ing ", "wh", "qu", "é", "ß", "ñ ", ". ", "!!\n", "中", "\x00"]) for _ in range(rng.randrange(300))) for _ in range(200)]
    texts += ["", "a", " ", "x" * 3000]
    counter = token_counts.counter(pieces.default_model())
    step, rows = counter.steps(texts)
    assert np.diff(rows).tolist() == [len(t) for t in texts]
    assert [int(step[a:b].sum()) for a, b in zip(rows[:-1], rows[1:])] == [len(x) for x in library.encode(texts)]
    for i in range(0, len(texts), 17):
        assert np.cumsum(np.append(0, step[rows[i] : rows[i + 1]])).tolist() == counter.all_prefixes(texts[i]).tolist()


def test_token_query_and_odd_rows(odd, none, library):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd).collect())
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 4096) for r in odd.collect())
    assert got == want
    assert token_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 100000])
def test_budget_and_prefix_questions_from_the_store(odd, none, library, budget, tmp_path):
    texts = collections.defaultdict(list)
    for r in odd.where("doc_id <> 11").collect():
        texts[r["doc_id"]].append(r["text"] or "")
    path = str(tmp_path / "store")
    token_counts.prefix_store(odd.where("doc_id <> 11")).write.parquet(path)
    store = odd.sparkSession.read.parquet(path)
    fits, costs = collections.defaultdict(list), collections.defaultdict(list)
    for r in token_counts.fit(store, budget).collect():
        fits[r["doc_id"]].append(r["fit_chars"])
    for r in token_counts.cost(store.withColumn("asked", F.col("n_chars") - 1), "asked").collect():
        costs[r["doc_id"]].append(r["prefix_tokens"])
    for d, own in texts.items():
        assert sorted(fits[d]) == sorted(max(i for i in range(len(t) + 1) if len(library.encode(t[:i])) <= budget) for t in own)
        assert sorted(costs[d]) == sorted(len(library.encode(t[: max(len(t) - 1, 0)])) for t in own)
    assert token_counts.fit(token_counts.prefix_store(none), budget).count() == 0


def test_other_models_are_refused():
    class Unigram:
        get_piece_size = lambda self: 2
        get_score = lambda self, i: -1.5
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    with pytest.raises(ValueError):
        pieces._check(Unigram(), "a.model")


def test_draws_do_not_depend_on_the_batch():
    own = sampling.sampler(pieces.default_model(), 1.0, 5)
    rng = random.Random(8)
    long_, short = (np.frombuffer((" " + "".join(rng.choice("abcdeés .,the ing") for _ in range(n))).encode("utf-32-le"), np.uint32) for n in (5000, 40))
    _, _, reach, first = own.lattice(np.concatenate([long_, short]), np.array([0, len(long_), len(long_) + len(short)]))
    _, _, alone, first_alone = own.lattice(short, np.array([0, len(short)]))
    for i in range(len(short)):
        a, b = first[len(long_) + i], first_alone[i]
        while True:
            assert reach[a] == alone[b]
            if alone[b] == 2.0:
                break
            a, b = a + 1, b + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=5), st.integers(0, 2**40))
def test_sampling_is_lossless_and_reproducible(texts, key):
    own = sampling.sampler(pieces.default_model(), 1.0, 5)
    keys = np.arange(len(texts)) + key
    ids, offsets = own.encode(keys, texts)
    raw, ends = own.decode(ids, offsets)
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == texts
    for i, t in enumerate(texts):
        alone, _ = own.encode(keys[i : i + 1], [t])
        assert alone.tolist() == ids[offsets[i] : offsets[i + 1]].tolist()


def test_samples_follow_the_lattice():
    own = sampling.sampler(pieces.default_model(), 0.5, 1)
    v = own.vocabulary

    def paths(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in v.by_text:
                yield from ((v.by_text[rest[:k]], *p) for p in paths(rest[k:]))

    weight = {p: math.exp(sum(own.weight[i] for i in p)) for p in paths("▁then")}
    n = 30_000
    ids, offsets = own.encode(np.arange(n), ["then"] * n)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:]))
    assert set(seen) <= set(weight)
    for p, w in weight.items():
        assert abs(seen[p] / n - w / sum(weight.values())) < 0.015


def test_sampling_query_and_decoding(odd, none):
    rows = sampling.roundtrip(odd).collect()
    assert len(rows) == 20 and all(r["lossless"] for r in rows)
    again = {(r["doc_id"], r["tokens_sha256"]) for r in sampling.roundtrip(odd.repartition(1)).collect()}
    assert again == {(r["doc_id"], r["tokens_sha256"]) for r in rows}
    decoded = sampling.decode_tokens(sampling.encode_sampled(odd)).collect()
    assert sorted(r["decoded"] for r in decoded) == sorted(r["text"] or "" for r in odd.collect())
    assert sampling.roundtrip(none).count() == 0
