"""Classifiers, SQL twins and the pipeline."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profilum.llm import quality, toxicity
from profilum.llm import text as X
from profilum.llm.labels import labelled_sample, remainder
from profilum.llm.registry import ORACLES, QUERIES

from .conftest import prose
from .test_chat_licenses_decontam import brute_hits
from .test_similarity import brute_links, brute_removal

DATA = "/root/testdata/sf0.001"


def labelled(seed=1, n=500):
    """Toxic texts hold words of a family; bad ones are tables and shouting."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        words = prose(rng, rng.randrange(20, 200)).split()
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = "vilest" + rng.choice(["one", "two", "ical", "ness", "ish", "er"])
        text = " ".join(words)
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: (t[:20] + "\n") * 30])(text)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).cache(), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").cache()


def measure(scored, labels, name, cut, held):
    rows = scored.join(labels, "doc_id").where(held).select("score", name).collect()
    return sum((s >= cut) == bool(y) for s, y in rows) / len(rows)


def test_toxicity_is_learnt(spark, tables, odd, none):
    docs, labels = tables
    model = toxicity.toxicity_model(docs, labels)
    scored = toxicity.score_documents(docs, model)
    assert measure(scored, labels, "toxic", 0.5, remainder(5) == 0) > 0.95
    unseen = toxicity.score_documents(spark.createDataFrame([(1, "the vilestly of w1x w2x and the vilestable"), (2, prose(random.Random(1), 60))], "doc_id bigint, text string"), model)
    got = {r["doc_id"]: r["score"] for r in unseen.collect()}
    assert got[1] > 0.5 > got[2]
    assert toxicity.score_documents(odd, model).count() == 20
    scores = collections.defaultdict(set)
    for r in toxicity.score_documents(odd, model).join(odd.select("doc_id", "text").distinct(), "doc_id").where("doc_id in (1, 2)").collect():
        scores[r["text"]].add(r["score"])
    assert all(len(s) == 1 for s in scores.values())
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_label_model_weighs_accurate_and_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    # three voters that are right by chance of their own: fewer don't tell how good each is
    right = (0.9, 0.95, 0.85)
    voters = [np.where((rng.random(4000) < p) == y, 1, -1) for p in right]
    noise = rng.choice([-1, 0, 1], 4000)
    posterior, told = toxicity.label_model(np.column_stack([*voters, noise, noise, noise]), 0.3)
    assert ((posterior > 0.5) == y).mean() > 0.94
    assert told["share"][3:].max() < 0.5 and told["share"][:3].min() > 0.9
    assert np.abs(told["rates"][:3, 0, 1] - right).max() < 0.04


def test_quality_is_learnt(tables, odd, none):
    docs, labels = tables
    forest = quality.quality_model(docs, labels)
    assert measure(quality.score_documents(docs, forest), labels, "quality", 0.7, remainder(4) == 2) > 0.97
    assert quality.score_documents(odd, forest).count() == 20
    assert quality.score_documents(none, forest).count() == 0


def test_trees_split_what_they_should():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality.fit_forest(x, y, trees=40, depth=3, rate=0.3)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
    slow = []
    for row in x[:50]:
        z = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            z += forest.value[t, node - forest.feature.shape[1]]
        slow.append(1 / (1 + np.exp(-z)))
    assert np.allclose(forest.score(x[:50]), slow, atol=1e-8)


def test_models_without_both_classes(spark, tables):
    docs, labels = tables
    nothing = labels.limit(0)
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.toxicity_model(docs, nothing)).collect()} == {0.0}
    ones = labels.withColumn("quality", F.lit(1))
    assert {r["score"] for r in quality.score_documents(docs, quality.quality_model(docs, ones)).collect()} == {1.0}


def test_samples_are_bounded_and_leave_held_out_rows(tables):
    docs, labels = tables
    rows = labelled_sample(docs, labels, "toxic", remainder(5) != 0, bound=100).collect()
    assert 40 < len(rows) < 200
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    doubled = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert labelled_sample(docs, doubled, "toxic", remainder(5) != 0).count() == labelled_sample(docs, labels, "toxic", remainder(5) != 0).count()


def test_many_texts_under_one_labelled_id_count_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (None, "x")], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["text"] for r in labelled_sample(docs, labels, "toxic", F.lit(True)).collect()}
    first = docs.where("doc_id = 1").select(F.min(F.struct(F.xxhash64("text"), "text"))["text"]).first()[0]
    assert got == {1: first, 2: ""}


TEXTS = ["", None, "One", "Vilest vilesten THE the, w1x! (naïve) 中文 [x] 12 45", "a | b | c!! #x\n\nsame line\nsame line\n  \t tab\x01", "word " * 300, "Ünïcode Wörter " * 7 + "end.\n"]


def brute_toxicity(model, text):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())]
    code = lambda b: int(X.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), seed=5)[0])
    seen = collections.Counter()
    for w in words:
        seen[code(w) >> (64 - toxicity.BITS)] += 1
        for k in toxicity.PREFIXES:
            if len(w) > k:
                seen[int(X.mix64(np.array([(code(w[:k]) + k) % 2**64], X.U64))[0]) >> (64 - toxicity.BITS)] += 1
    z = model.bias
    for cell, n in seen.items():
        density = 100.0 * n / len(words)
        z += model.weights[cell] * np.float32(density if model.cut is None else min(density, model.cut))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


@pytest.mark.parametrize("settings", [toxicity.DEFAULT, toxicity.Settings(voters=None, features=None, cut=None)])
def test_toxicity_scores_against_brute_force(spark, tables, settings):
    model = toxicity.toxicity_model(*tables, settings=settings)
    assert np.abs(model.weights).max() > 0 and model.cut == settings.cut
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(100 + r["doc_id"], r["text"]) for r in tables[0].limit(40).collect()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    for r in docs.collect():
        assert abs(got[r["doc_id"]] - brute_toxicity(model, r["text"])) < 1e-6


def brute_statistics(text):
    b = (text or "").encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", b), re.findall(rb"[^\n]+", b)
    letters, size, n = max(sum(chr(c).isalpha() and c < 128 for c in b), 1), max(len(b), 1), max(len(words), 1)
    count = lambda chars: sum(b.count(bytes([c])) for c in chars)
    pairs = list(zip(words, words[1:]))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    upper = range(0x41, 0x5B)
    return [
        math.log1p(len(words)), mean, math.sqrt(max(sum(k * k for k in lengths) / n - mean**2, 0)), math.log1p(len(lines)), n / max(len(lines), 1), count(upper) / letters, sum(w[0] in upper for w in words) / n,
        count(b"0123456789") / size, sum(c >= 0x80 for c in b) / size, count(b" ") / size,
        *(b.count(c.encode()) / n for c in ",.!?|#$%&*"), count(b"@^~_=+<>/\\") / n,
        len(set(words)) / n, max(collections.Counter(words).values(), default=0) / n, 1 - len(set(pairs)) / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(k <= 3 for k in lengths) / n, sum(k <= 2 for k in lengths) / n, sum(k >= 12 for k in lengths) / n, sum(w[-1] in b"#$%&*|!" for w in words) / n, sum(x == y for x, y in pairs) / n,
        sum(c < 32 and c != 10 for c in b) / size, count(b"()[]{}") / size,
    ]


def test_quality_statistics_against_brute_force():
    texts = TEXTS + [t for _, t in labelled(4, 60)[0]]
    got = quality.statistics(pa.array(texts, pa.string()))
    for row, text in zip(got, texts):
        assert np.allclose(row, brute_statistics(text), atol=1e-9), text


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), connection.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    sort = lambda f: f[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert sort(got).equals(sort(want))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    docs, labels = labelled(7, 300)
    items = [(i, prose(rng, 25)) for i in range(6)]
    passage = prose(rng, 50)
    texts = [t for _, t in docs]
    texts += [t + " tail" for t in texts[:20]] + texts[20:30] + [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(6)] + [f"{prose(rng, 30)} {t} {prose(rng, 9)}" for _, t in items] + [None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen[name] = now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != kept[-1]:
            assert now.columns == columns
    rows = lambda n: {r["doc_id"]: r["text"] for r in seen[n].collect()}
    a, b, c, d = (rows(n) for n in kept[:4])
    truth = {i: y for i, _, y in labels}
    assert sum(truth.get(i, 0) for i in a) <= 0.1 * sum(truth.values()) and len(a) > 250
    component = {r[0]: r[2] for r in brute_links(sorted(a.items()))}
    assert set(b) == set(component.values()) and all(a[i] == t for i, t in b.items())
    removed = {r[0]: r for r in brute_removal(sorted(b.items()))}
    assert all((c[i] == b[i]) == (removed[i][2] == 0) and len((c[i] or "").split()) == removed[i][1] - removed[i][2] for i in b)
    assert set(d) == {i for i, t in c.items() if not brute_hits(t, items)[-1]}
    assert {r["doc_id"]: r["lossless"] for r in seen[kept[4]].collect()} == {i: True for i in d}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(d)


@pytest.mark.parametrize("empty", [(), ("labels", "benchmark"), ("documents", "labels", "benchmark")])
def test_pipeline_of_odd_rows_and_empty_tables(spark, odd, none, tmp_path, empty):
    labels = spark.createDataFrame([(1, 0, 0), (7, 1, 0), (None, 1, 1), (9, 1, None)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "w1x w2x w3x never here"), (None, None), (2, "")], "item_id bigint, text string")
    renamed = lambda t: t.withColumnsRenamed({"k1": "text_k1", "sid": "KEPT_ID", "bucket": "Text_Runs"})
    for name, full, nothing in (("documents", renamed(odd), renamed(none)), ("labels", labels, labels.limit(0)), ("benchmark", items, items.limit(0))):
        (nothing if name in empty else full).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == corpus_pipeline.STAGES[-1][0] or now.columns == columns
    got = now.collect()
    assert len(got) == corpus_pipeline.run(spark, str(tmp_path)).count()
    if "documents" in empty:
        assert got == []
    else:
        # nothing scores as toxic where all labels say clean; copies and repeated rows are gone
        assert all(r["lossless"] for r in got) and len({(r["doc_id"], r["decoded_sha256"]) for r in got}) == len(got)
        assert {3, 4, 5} <= {r["doc_id"] for r in got}
