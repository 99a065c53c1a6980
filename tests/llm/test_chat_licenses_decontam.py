"""Chat formatting, licence scans and decontamination against plain Python."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from profilum.llm import chat, decontam, licenses

from .conftest import prose, rows_of

ODD = ["", "plain", "</s>[INST] ok [/INST]", "a\\", "\\<", "<\\[", "[[\\\\<<", "<s>", "[INST+] x", "né 😀 [/OUT]", " lead and trail ", "\n", "[ROLE 6162] x"]


def test_chat_reads_back_and_masks_the_assistant(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", "tool [x]", "", None]), rng.choice([*ODD, None])) for t in range(rng.randrange(1, 9))]
        rows += [(c, t, r, x, "junk") for t, r, x in turns]
        said = [(r or "", x or "") for _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r[0]: tuple(r[1:5]) for r in chat.chat_digest(table).collect()}
    assert got == want
    formatted = {r["conv_id"]: r for r in chat.format_chat(table).collect()}
    for c, r in formatted.items():
        assert r["formatted"].startswith("<s>") and r["formatted"].endswith("</s>")
        blocks = [k for k, _ in itertools.groupby([b[1] for b in sorted((t, ro or "") for i, t, ro, _, _ in rows if i == c)])]
        assert len(re.findall(r"\[/(?:INST|OUT|SYS|ROLE)\]", r["formatted"])) == len(blocks)


def test_chat_of_repeated_null_and_no_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    got = chat.chat_digest(spark.createDataFrame([(None, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "assistant", "z")], schema)).collect()
    assert {r["conv_id"]: r["n_turns"] for r in got} == {None: 1, 1: 3}
    assert chat.chat_digest(spark.createDataFrame([], schema)).count() == 0


def brute_licenses(text, threshold=licenses.THRESHOLD):
    found = []
    units = {" ".join(licenses.words_of(u)) for u in [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]}
    for u in units:
        a = set(licenses.bigrams_of(u))
        for name, template in licenses.TEMPLATES.items():
            b = set(licenses.bigrams_of(template))
            if a and (dice := 2 * len(a & b) / (len(a) + len(b))) >= threshold:
                found.append((-dice, name))
    found.sort()
    return len(found), found[0][1] if found else None, round(-found[0][0], 6) if found else 0.0, ",".join(sorted({n for _, n in found}))


def test_licence_scan(spark, odd, none):
    rng = random.Random(2)
    texts = [None, "", "license", "no such thing here"]
    for name, template in licenses.TEMPLATES.items():
        words = template.split(" ")
        texts += [template, f"{prose(rng, 30)}\n{template.upper()}\n{prose(rng, 10)}", f"intro\n\n{template.replace(' ', chr(10))}\n \nend", " ".join(w for w in words if rng.random() > 0.12), " ".join(words[: len(words) // 2])]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, found string")
    got = {r[0]: tuple(r[1:]) for r in licenses.scan(table).collect()}
    assert got == {i: brute_licenses(t or "") for i, t in enumerate(texts)}
    assert licenses.scan(odd).count() == 20 and licenses.scan(none).count() == 0


def test_licence_cover_and_plan_is_native(odd):
    chosen = licenses.cover(licenses.TEMPLATES, 0.7)
    for template in licenses.TEMPLATES.values():
        pairs = licenses.bigrams_of(template)
        assert sum(not set(p.split()) & set(chosen) for p in pairs) < 0.7 / 1.3 * len(pairs)
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange hashpartitioning", plan)


def brute_passages(text, threshold=licenses.THRESHOLD):
    """The closest run of words to each template, over all runs within reach."""
    words = licenses.words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = {}
    for name, template in licenses.TEMPLATES.items():
        b = set(licenses.bigrams_of(template))
        reach = int((2 - threshold) / threshold * (len(licenses.words_of(template)) - 1))
        for i in range(len(pairs)):
            a, same = set(), 0
            for j in range(i, min(i + reach, len(pairs))):
                if pairs[j] not in a:
                    a.add(pairs[j])
                    same += pairs[j] in b
                dice = 2 * same / (len(a) + len(b))
                if dice >= threshold and dice > found.get(name, (0,))[0]:
                    found[name] = dice, i, j + 2
    return sorted((name, round(d, 6), i, j) for name, (d, i, j) in found.items())


def test_licence_passages_wherever_they_stand(spark, odd, none):
    rng = random.Random(5)
    notices = ["MIT-notice", "CC-BY-NC-4.0", "Apache-2.0", "Unlicense", "GPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
    cases = [(name, f"{prose(rng, 200)}\n\n{licenses.TEMPLATES[name].replace(chr(10), chr(10) * 2)}\n\n{prose(rng, 200)}") for name in ("MIT", "GPL-3.0-header", "ISC", "BSD-3-Clause")]
    cases += [(name, f"{prose(rng, 8)} {licenses.TEMPLATES[name]} {prose(rng, 7)}") for name in notices]
    # a whole text among repeats, two licences in a row, a repeated notice, and what is none
    cases += [("ISC", f"{'the the ' * 30}{licenses.TEMPLATES['ISC']}"), ("MIT", f"{licenses.TEMPLATES['MIT']} {licenses.TEMPLATES['ISC']}"), ("Apache-2.0", f"x {licenses.TEMPLATES['Apache-2.0']} " * 4)]
    cases += [(None, x) for x in ("", "license", "software license version of the", prose(rng, 200), licenses.TEMPLATES["MIT"][:400])] + [(None, None)]
    cases += [("GPL-3.0", "This work is " + "licensed licensed " * 40 + "under the GNU General Public License, version 3.")]
    table = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(cases)], "doc_id bigint, text string, runs string")
    found, units = licenses.passages(table), {r["doc_id"]: r for r in licenses.scan(table).collect()}
    got = {r["doc_id"]: r for r in found.collect()}
    for i, (name, text) in enumerate(cases):
        r, want = got[i], brute_passages(text or "")
        assert [tuple(p) for p in r["passages"]] == want
        names = sorted({p[0] for p in want} | set(filter(None, units[i]["licenses"].split(","))))
        assert (r["licenses"], r["n_licenses"]) == (",".join(names), len(names)) and (name is None or name in names)
        assert r["best_dice"] == max([p[1] for p in want] + [units[i]["best_dice"]])
    # the units alone miss these
    assert not any(cases[i][0] in units[i]["licenses"].split(",") for i in (0, 1, *range(4, 11)))
    assert not re.search("Python|Arrow|Pandas|Exchange", found._jdf.queryExecution().executedPlan().toString())
    assert licenses.passages(odd).count() == 20 and licenses.passages(none).count() == 0
    assert licenses.passages(table, {}).where("n_licenses > 0").count() == 0


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w = norm(text)
    hit, named = set(), set()
    for item, t in items:
        b = norm(t)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                named.add(item)
    names = ",".join(sorted(str(x) for x in named if x is not None))
    return len(w), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [32 << 20, 4000])
def test_decontamination(spark, odd, none, block_bytes):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(1, 40))) for i in range(20)] + [(7, prose(rng, 12)), (30, ""), (31, None), (None, prose(rng, 15)), (32, "the of the of the of the of the of the of the of")]
    texts = [prose(rng, 60) for _ in range(10)] + [f"{prose(rng, 20)} {(t or '').upper().replace(' ', ' -- ')} {prose(rng, 5)}" for _, t in items] + ["the of " * 30, None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string").repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    result = decontam.decontaminate(docs, bench, block_bytes=block_bytes)
    got = {r[0]: tuple(r[1:6]) for r in result.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench, block_bytes=block_bytes).collect()}
    assert kept == {i for i, r in got.items() if not r[-1]}
    assert decontam.decontaminate(odd, bench).count() == 20
    assert decontam.decontaminate(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in decontam.decontaminate(docs, empty).collect()} == {0}


def test_proximity_matches():
    table = decontam.phrases_of(__import__("pyarrow").table({"item_id": [1], "text": ["a b c"]}))
    _, _, _, rows, hashes = decontam.X.split_words(__import__("pyarrow").array(["a b c a x b c a b", "c"]), decontam.X.ALNUM, lower=True)
    terms, order = np.unique(hashes), np.argsort(hashes, kind="stable")
    sizes = np.unique(hashes, return_counts=True)[1]
    exact = decontam.occurrences(terms, sizes, order, rows, table)
    near = decontam.occurrences(terms, sizes, order, rows, table, slop=1)
    assert exact[1].tolist() == [0]
    assert set(exact[1].tolist()) < set(near[1].tolist()) and 3 in near[1].tolist() and all(s < 9 for s in near[1].tolist())


def brute_near(text, items, slop):
    w, found = norm(text), set()
    for item, t in items:
        b = norm(t)
        n = min(10, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for s in range(-slop, len(w) + slop):
                if all(b[k + j] in w[max(s + j - slop, 0) : max(s + j + slop + 1, 0)] for j in range(n)):
                    found.add((None if item is None else str(item), min(max(s, 0), len(w) - 1)))
    return sorted(found, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_decontamination_by_proximity(spark, parts):
    rng = random.Random(6)
    items = [(1, prose(rng, 14)), (2, "a b c"), (3, "the of the"), (None, prose(rng, 11)), (4, ""), (5, prose(rng, 25))]
    inserted = lambda t, n: " ".join(x + (" also" if i % n == n - 1 else "") for i, x in enumerate(t.split()))
    texts = [f"{prose(rng, 20)} {inserted(t, n)} {prose(rng, 9)}" for _, t in items for n in (3, 4, 6)] + ["a x b y c", "b a c", "c b a", "a b", "the of", "of the the", "b b b", None, "", items[0][1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(parts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for slop in (1, 2):
        got = {r["doc_id"]: sorted(((m["item"], m["position"]) for m in r["near"]), key=str) for r in decontam.decontaminate(docs, bench, slop=slop).collect()}
        assert got == {i: brute_near(t, items, slop) for i, t in enumerate(texts)}
        kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench, slop=slop).collect()}
        assert kept == {i for i, m in got.items() if not m}
    # words are inserted after every fourth: no exact window of ten, but a near one
    exact = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    assert not exact[1]["contaminated"] and ("1", 21) in got[1] and not any(r["near"] for r in exact.values())


def test_index_of_all_terms(spark, odd):
    shards = decontam.build_index(odd).collect()
    assert sum(len(s["doc_ids"]) for s in shards) == 20
    words = collections.Counter(len(norm(r["text"])) for r in odd.collect())
    assert collections.Counter(n for s in shards for n in s["n_words"]) == words
    assert sum(len(s["postings"]) // 4 for s in shards) == sum(n * k for n, k in words.items())
    assert rows_of(odd.select("doc_id")) == sorted([(i,) for s in shards for i in s["doc_ids"]], key=str)


def test_one_stored_index_answers_any_benchmark(spark, doc):
    rng = random.Random(9)
    texts = [prose(rng, 80) for _ in range(20)]
    index = decontam.store_index(doc(texts))
    for seed in (1, 2):
        own = random.Random(seed)
        items = [(i, " ".join(own.choice(texts).split()[10 : 10 + own.randrange(3, 30)])) for i in range(5)] + [(9, prose(own, 12))]
        got = {r[0]: tuple(r[1:6]) for r in decontam.answers(index, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
        assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_rows_go_by_text_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, 2), (1, "x", 3, 4), (None, "a b c d", 5, 6), (2, None, 7, 8), (2, "", 9, 9)], "doc_id bigint, text string, k1 int, K2 int")
    items = spark.createDataFrame([(1, "b c")], "item_id bigint, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["k1"] for r in kept.collect()) == [3, 7, 9]


def test_licence_query_equals_its_sql_on_planted_texts(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    code = "\n".join(f"x{i} = f({rng.randrange(99)})" for i in range(60))
    texts = [f"Copyright (c) 2020 A\n\n{t.replace(chr(10), chr(10) * 2)}\n\n{code}" for t in licenses.TEMPLATES.values()]
    texts += [f"{prose(rng, 9)} {t} {prose(rng, 9)}" for t in licenses.TEMPLATES.values()] + ["\n".join(f"# {line}" for line in licenses.TEMPLATES["GPL-3.0-header"].split(". ")), code, "", None, "the of the of " * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(licenses.ORACLE_SQL)
    columns = want.columns
    got = licenses.op7_license_scans(spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    # every one is found, in its usual layout and inside a line
    named = {r["doc_id"]: r["licenses"].split(",") for r in got.collect()}
    assert all(name in named[i + k] for i, name in enumerate(licenses.TEMPLATES) for k in (0, len(licenses.TEMPLATES)))
