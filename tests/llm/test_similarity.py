"""Jaccard join, substring removal and components against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from profilum.llm import components, jaccard, substrings

from .conftest import prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_links(rows):
    """(doc_id, size, component, links) of all rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return collections.Counter((d, len(s), min(least[find(i)], default=None) if s else d, n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links)))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(len(w))
        if k == 0:
            w[at] = f"e{rng.randrange(9999)}"
        elif k == 1:
            w.insert(at, "new")
        elif len(w) > 1:
            del w[at]
    return " ".join(w)


def near_copies(seed):
    rng = random.Random(seed)
    texts = []
    line = prose(rng, 14)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 80, 200):
        for _ in range(4):
            base = prose(rng, n)
            texts += [base, (line + " " + base), base.upper()] + [edited(rng, base, rng.randrange(1, max(2, n // 20) + 2)) for _ in range(4)]
    base = prose(rng, 120)
    texts += [edited(rng, base, rng.randrange(0, 9)) for _ in range(40)] + [base] * 9
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(doc, seed):
    rows = list(enumerate(near_copies(seed)))
    got = collections.Counter(map(tuple, jaccard.similar_documents(doc([t for _, t in rows])).collect()))
    assert got == brute_links(rows)


def test_links_of_odd_rows(odd, none):
    got = collections.Counter(map(tuple, jaccard.similar_documents(odd).collect()))
    assert got == brute_links([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard.similar_documents(none).count() == 0


@pytest.mark.parametrize("small", [2, 6, 64])
def test_blocks_and_single_pairs_lose_no_link(doc, monkeypatch, small):
    """Large clusters taken apart: cores in blocks, and pairs of values that few sets share."""
    monkeypatch.setattr(jaccard, "PER_TASK", 900)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = list(enumerate(near_copies(5)))
    got = collections.Counter(map(tuple, jaccard.similar_documents(doc([t for _, t in rows])).collect()))
    assert got == brute_links(rows)


@pytest.mark.parametrize("q", [0, 1, 2, 3])
def test_every_similar_pair_shares_an_index_value(q):
    """Each allocation of deletion neighbourhoods, over pairs at the threshold."""
    rng = np.random.default_rng(q)
    own = jaccard.Signatures({b: q for b in range(12)})
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 13, 20, 33, 64, 100, 257):
        for _ in range(12):
            base = rng.integers(1, 2**63, n + n // 3 + 2, dtype=np.uint64)
            drop = int(rng.integers(0, n // 4 + 1))
            a, b = np.unique(base[:n]), np.unique(base[drop:n + int(rng.integers(0, n // 3 + 2))])
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            chosen = []
            for s in (a, b):
                mine = set()
                for table, _, value, kind in own.values(s, np.array([0, len(s)]), np.array([1])):
                    need, full = int(table["need"][0]), int(table["full"][0])
                    plain, empty = (np.sort(value[kind == k]) for k in (jaccard.PLAIN, jaccard.EMPTY))
                    assert len(plain) == full
                    mine |= set(plain[:need].tolist()) | set(empty[: max(0, need - full)].tolist()) | set(value[kind == jaccard.NEAR].tolist())
                chosen.append(mine)
            assert chosen[0] & chosen[1], (n, len(a), len(b))


def test_hot_values_lose_no_link(doc, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 6)
    rows = list(enumerate(near_copies(6)))
    docs = doc([t for _, t in rows])
    assert len(jaccard.hot_values(docs, jaccard.Signatures({}), 10)) > 0
    got = collections.Counter(map(tuple, jaccard.similar_documents(docs).collect()))
    assert got == brute_links(rows)


def test_allocation_uses_neighbourhoods_where_segments_lack(monkeypatch):
    assert jaccard.allocate({9: 10_000})[9] == 0 and jaccard.allocate({2: 10**9})[2] == 0
    monkeypatch.setattr(jaccard, "segments_of", lambda upper: upper)
    assert jaccard.allocate({2: 10**6})[2] > 0


@pytest.mark.parametrize("q", [0, 1])
def test_no_value_is_common_to_unlike_small_sets(q):
    """Random sets of one size: no value but by chance, neither of empty segments nor of nearly empty neighbourhoods."""
    own = jaccard.Signatures({b: q for b in range(12)})
    rng = np.random.default_rng(1)
    # smaller sets get no neighbourhoods from ``allocate``
    for n in (3, 4, 5, 6, 7, 8, 12, 20, 40) if q == 0 else (20, 40, 80):
        flat = np.sort(rng.integers(1, 2**63, (3000, n), dtype=np.uint64), axis=1).ravel()
        seen = []
        for table, owner, value, kind in own.values(flat, np.arange(0, len(flat) + 1, n), np.arange(3000)):
            need = table["need"].astype(int)
            seen.append(value[(kind != jaccard.EMPTY) | (table["full"] < need)[owner]])
        counts = np.unique(np.concatenate(seen), return_counts=True)[1]
        assert counts.max() <= 8, n


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(20)] + [(500, 500), (600, 601), (601, 600), (602, 600)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(20)}, 601: 600, 602: 600}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_removal(rows, size=35):
    count = collections.Counter()
    split = [words(t) for _, t in rows]
    for w in split:
        for i in range(len(w) - size + 1):
            count[tuple(w[i : i + size])] += 1
    out = collections.Counter()
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_removal_of_repeats(doc, odd, none):
    rng = random.Random(4)
    passage, loop = prose(rng, 50), prose(rng, 20)
    texts = [prose(rng, rng.randrange(0, 90)) for _ in range(30)]
    texts += [f"{prose(rng, rng.randrange(30))} {passage}  {prose(rng, rng.randrange(30))}" for _ in range(25)]
    texts += [" ".join([loop] * 5), passage, texts[3], texts[3], " ".join(passage.split()[:34]), " ".join(["the"] * 90)]
    got = collections.Counter(map(tuple, substrings.dedup_digest(doc(texts)).collect()))
    assert got == brute_removal(list(enumerate(texts)))
    got = collections.Counter(map(tuple, substrings.dedup_digest(odd).collect()))
    assert got == brute_removal([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert substrings.dedup_digest(none).count() == 0
    whole = substrings.remove_repeats(odd)
    assert whole.columns == odd.columns and whole.count() == odd.count()


def test_a_small_sketch_changes_nothing(doc, monkeypatch):
    rng = random.Random(9)
    passage = prose(rng, 45)
    texts = [prose(rng, 200) for _ in range(20)] + [prose(rng, 40) + " " + passage for _ in range(5)]
    monkeypatch.setattr(substrings, "MIN_CELLS", 64)
    monkeypatch.setattr(substrings, "MAX_CELLS", 64)
    monkeypatch.setattr(substrings, "HELD", 300)
    got = collections.Counter(map(tuple, substrings.dedup_digest(doc(texts)).collect()))
    assert got == brute_removal(list(enumerate(texts)))


def test_one_row_of_each_component_with_null_and_repeated_ids(spark, odd, none):
    rng = random.Random(12)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, a), (2, a), (None, a), (None, near(a)), (None, b), (None, b), (None, near(b)), (3, c), (3, near(c)), (4, a), (4, d), (None, ""), (None, None), (None, " \n"), (5, ""), (5, ""), (6, None), (7, e), (7, e), (8, near(e))]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, sid int").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(table).collect()]
    one = lambda texts: [r for r in got if r[1] in texts]
    assert one([a, near(a)]) == [(1, a)] and one([d]) == [(4, d)] and one([e, near(e)]) == [(7, e)]
    assert len(one([b, near(b)])) == 1 and len(one([c, near(c)])) == 1
    assert sorted([r for r in got if not (r[1] or "").strip()], key=str) == sorted([(None, ""), (None, None), (None, " \n"), (5, ""), (6, None)], key=str)
    assert len(got) == 10
    kept = jaccard.one_of_each(odd).collect()
    words = [r for r in kept if (r["text"] or "").strip()]
    # the odd table: equal sets, a null-id copy of 9, and 16 twice with texts of two components
    assert sorted(r["doc_id"] for r in words if r["doc_id"] is not None) == sorted(r["doc_id"] for r in words)
    assert len({(r["doc_id"], r["text"]) for r in words}) == len(words) and sum(r["doc_id"] == 16 for r in words) == 2
    assert sum(r["doc_id"] is None for r in kept) == 1 and jaccard.one_of_each(none).count() == 0
