"""Readers, options, search modes, results, registry and command line."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import profilum as P
from profilum import chunk_bench, cli, config, databases
from profilum.functions.residues import AMINO, reverse_complement
from profilum.functions.stats import general, scientific
from profilum.kernel.build import conditional, from_sequence
from profilum.kernel.model import background
from profilum.operators import hits as H
from profilum.operators.result import SearchResult
from profilum.plans import score as S
from profilum.schema import RESULT
from profilum.sources.fasta import from_list, read_sequences, write_sequences
from profilum.sources.files import parts
from profilum.sources.profiles import format_profile, parse_profile, read_profiles, write_profiles

FIRST, SECOND = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGD", "GSHMWQPLNDTEEYCRKIVHAFLSDNPWGKYTRMCVEIQALHPFD"


def record(name, residues, alphabet="amino", **more):
    p = from_sequence(name, residues, alphabet)
    nlog = lambda m: [[None if v == 0 else float(-np.log(v)) for v in r] for r in m]
    stat = lambda k, w: {w: p.stats[k][0], "lambda": p.stats[k][1]}
    return {
        "format_version": "HMMER3/f", "name": name, "accession": None, "description": None, "model_length": p.length, "max_length": more.get("max_length"), "alphabet": alphabet, "nseq": 1, "effn": 1.0, "cksum": 7,
        **{c: more.get(c) and {"seq": more[c], "dom": more[c]} for c in ("ga", "tc", "nc")}, "stats_msv": stat("msv", "mu"), "stats_viterbi": stat("viterbi", "mu"), "stats_forward": stat("forward", "tau"),
        "compo": None, "match_nlog": nlog(p.match), "insert_nlog": nlog(p.insert), "trans_nlog": nlog(p.trans), "consensus": residues.lower(), "map": list(range(1, p.length + 1)),
    }


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "two.hmm").write_text(format_profile(record("one", FIRST, ga=20.0, tc=25.0, nc=15.0)) + format_profile(record("two", SECOND, nc=500.0)))
    (top / "p.faa").write_text(f">a first # 1 > 2\r\n{FIRST[:20]}\r\n{FIRST[20:]}*\r\n>b\n{SECOND.lower()}\n>c x\n{'AG' * 30}\n>d\nXX{FIRST[3:35]}WW")
    folder = top / "many"
    folder.mkdir()
    (folder / "x.FAA").write_text(f">x1\n{FIRST}\n")
    with gzip.open(folder / "skip.txt", "wt") as f:
        f.write("no")
    (folder / "bad.fa").write_text(">q\nMK9\n")
    (folder / "empty.fasta").write_text("")
    return top


def test_sequences_are_parsed(spark, files):
    rows = read_sequences(spark, str(files / "p.faa")).orderBy("record_index").collect()
    assert [(r["sequence_id"], r["description"], r["length"]) for r in rows] == [("a", "first # 1 > 2", 43), ("b", None, 45), ("c", "x", 60), ("d", None, 36)]
    assert rows[0]["residues"] == FIRST + "*" and rows[1]["residues"] == SECOND.lower()
    assert [r["sequence_id"] for r in read_sequences(spark, str(files / "many")).collect()] == ["x1"]
    with pytest.raises(Exception, match="not amino FASTA"):
        read_sequences(spark, str(files / "many/bad.fa")).collect()
    with pytest.raises(ValueError, match="empty"):
        read_sequences(spark, str(files / "many/empty.fasta"))
    with pytest.raises(FileNotFoundError):
        read_sequences(spark, str(files / "nowhere"))
    memory = read_sequences(spark, spark.createDataFrame([("m", FIRST)], "sequence_id string, residues string")).first()
    assert memory["source_path"] == "<memory>" and memory["length"] == len(FIRST)


def test_profiles_are_parsed_and_written(spark, files, tmp_path):
    rows = {r["name"]: r for r in read_profiles(spark, str(files / "two.hmm")).collect()}
    assert set(rows) == {"one", "two"} and rows["one"]["ga"]["seq"] == 20.0 and rows["two"]["ga"] is None
    again = parse_profile(format_profile(rows["one"].asDict(recursive=True)).split("\n//")[0])
    assert np.allclose(np.array(again["match_nlog"]), np.array(rows["one"]["match_nlog"]), atol=1e-5) and again["trans_nlog"][-1][2] is None
    for text in ("", "junk", "HMMER3/f\nNAME x\n"):
        with pytest.raises(ValueError):
            parse_profile(text)
    (tmp_path / "z.hmm").write_text("junk\n//\n")
    with pytest.raises(Exception, match="not a HMMER3 profile"):
        read_profiles(spark, str(tmp_path / "z.hmm")).collect()
    (tmp_path / "ok.hmm").write_text(format_profile(record("fine", FIRST)))
    assert [r["name"] for r in read_profiles(spark, str(tmp_path)).collect()] == ["fine"]


def test_search_scan_and_thresholds(spark, files):
    sequences, hmms = str(files / "p.faa"), str(files / "two.hmm")
    found = P.search(spark, sequences, hmms)
    rows = {(r["sequence_id"], r["hmm_name"]): r for r in found.df.collect()}
    assert set(rows) == {("a", "one"), ("b", "two"), ("d", "one")} and found.df.columns == RESULT.fieldNames()
    scanned = {(r["sequence_id"], r["hmm_name"]): r for r in P.scan(spark, sequences, hmms).df.collect()}
    assert {k: round(r["bitscore"], 6) for k, r in scanned.items()} == {k: round(r["bitscore"], 6) for k, r in rows.items()}
    a = ("a", "one")
    assert abs(rows[a]["evalue"] / scanned[a]["evalue"] - 4 / 2) < 1e-9
    assert abs(P.search(spark, sequences, hmms, z=400).df.where("sequence_id = 'a'").first()["evalue"] / rows[a]["evalue"] - 100) < 1e-6
    with pytest.raises(ValueError, match="gathering"):
        P.search(spark, sequences, hmms, thresholds=P.ThresholdOptions(cut_ga=True))
    cascade = {(r["sequence_id"], r["hmm_name"]) for r in P.search(spark, sequences, hmms, thresholds=P.ThresholdOptions(cascade=True)).df.collect()}
    assert ("b", "two") not in cascade and a in cascade
    assert P.search(spark, sequences, hmms, thresholds=P.ThresholdOptions(bitscore=1000.0)).df.count() == 0


def test_files_written_are_read_back(spark, files, tmp_path):
    sequences, profiles = read_sequences(spark, str(files / "p.faa")), read_profiles(spark, str(files / "two.hmm"))
    write_sequences(sequences, str(tmp_path / "f"), width=7)
    write_profiles(profiles, str(tmp_path / "h"))
    back = read_sequences(spark, parts(spark, str(tmp_path / "f")))
    kept = ("sequence_id", "description", "residues", "length", "alphabet")
    assert sorted(back.select(*kept).collect(), key=str) == sorted(sequences.select(*kept).collect(), key=str)
    again = read_profiles(spark, parts(spark, str(tmp_path / "h")))
    assert again.drop("source_path", "profile_index").orderBy("name").collect() == profiles.drop("source_path", "profile_index").orderBy("name").collect()


def test_chunks_of_profiles_share_one_pass(spark, files, monkeypatch):
    def found():
        sequences, packed = read_sequences(spark, str(files / "p.faa")), S.pack(read_profiles(spark, str(files / "two.hmm")))
        raw = S.score(sequences, packed)
        scores = S.filter_scores(sequences, packed).orderBy("profile_index", "record_index").collect()
        return raw.orderBy("profile_index", "record_index").collect(), scores, raw._jdf.queryExecution().executedPlan().toString()

    whole = found()
    monkeypatch.setattr(S, "PROFILES_AT_ONCE", 1)
    single = found()
    assert whole[:2] == single[:2] and len({r["profile_index"] for r in whole[0]}) == 2
    assert "Union" not in single[2] and single[2].count("MapInPandas") == 1


def test_bench_by_chunks(spark, files, tmp_path):
    out = tmp_path / "b.csv"
    for limit, lines in ((1, 2), (9, 4)):
        assert chunk_bench.main(["--hmms", str(files / "two.hmm"), "--sequences", str(files / "p.faa"), "--chunk-size", "1", "--max-chunks", str(limit), "--out", str(out)]) == 0
        assert len(out.read_text().splitlines()) == lines
    rows = [line.split(",") for line in out.read_text().splitlines()]
    assert tuple(rows[0]) == chunk_bench.COLUMNS and [r[4] for r in rows[1:]] == ["0", "0", "1"]
    chunks = chunk_bench.with_chunks(read_profiles(spark, str(files / "two.hmm")), 2)
    assert [r["chunk"] for r in chunks.collect()] == [0, 0] and chunk_bench.resident_mb() > 0
    with pytest.raises(ValueError):
        chunk_bench.with_chunks(chunks, 0)


def test_options_are_checked(spark, files):
    for bad in ({"cut_ga": True, "cut_tc": True}, {"cascade": True, "cut_nc": True}):
        with pytest.raises(ValueError):
            P.ThresholdOptions(**bad)
    with pytest.raises(ValueError):
        P.phmmer(spark, str(files / "p.faa"), str(files / "p.faa"), thresholds=P.ThresholdOptions(cascade=True))
    with pytest.raises(ValueError, match="single file"):
        P.phmmer(spark, [str(files / "p.faa"), str(files / "many/x.FAA")], str(files / "p.faa"))
    with pytest.raises(FileNotFoundError):
        P.search(spark, str(files / "p.faa"), "NoSuchDatabase")


def test_sequence_queries_and_iteration(spark):
    rng = np.random.default_rng(1)
    p = conditional("amino")
    change = lambda s, share: "".join(AMINO[rng.choice(20, p=p[AMINO.index(c)])] if rng.random() < share else c for c in s)
    family = [("q", FIRST + SECOND)]
    for i in range(5):
        family.append((f"m{i}", change(family[-1][1], 0.35)))
    noise = [(f"n{i}", "".join(rng.choice(list(AMINO), 80, p=background("amino")))) for i in range(10)]
    query, target = from_list(spark, family[:1]), from_list(spark, family + noise)
    once = {r["sequence_id"] for r in P.phmmer(spark, query, target).nested.collect()}
    more = {r["sequence_id"] for r in P.jackhmmer(spark, query, target, max_iterations=4).nested.collect()}
    assert "q" in once <= more and not any(n.startswith("n") for n in more)
    last = P.jackhmmer(spark, query, target, max_iterations=1, legacy_last_only=True).nested.select("hmm_name").distinct().collect()
    assert [r[0] for r in last] == ["jackhmmer_query"]


def test_registered_iteration_runs_all_rounds(spark, monkeypatch):
    import inspect

    import __spark_entry__
    from profilum.plans import search

    rounds = []
    whole = inspect.signature(search.jackhmmer)

    class Result:
        df = None

    def recorded(*args, **more):
        bound = whole.bind(*args, **more)
        bound.apply_defaults()
        rounds.append(bound.arguments["max_iterations"])
        return Result

    monkeypatch.setattr(search, "jackhmmer", recorded)
    __spark_entry__.queries()["jackhmmer_full"](spark, "/root/testdata/sf0.001")
    assert rounds == [whole.parameters["max_iterations"].default] == [5]


def test_nucleotides_on_both_strands(spark):
    rng = np.random.default_rng(4)
    motif = "".join(rng.choice(list("ACGT"), 60))
    other = motif[::-1].translate(str.maketrans("ACGT", "TGCA"))
    noise = lambda n: "".join(rng.choice(list("ACGT"), n))
    target = spark.createDataFrame([("fwd", noise(700) + motif + noise(300)), ("rev", noise(150) + other + noise(900)), ("no", noise(500))], "sequence_id string, residues string")
    hmms = spark.createDataFrame([record("m", motif, "dna") | {"source_path": "x", "profile_index": 0}], read_profiles_schema())
    rows = {r["sequence_id"]: r for r in P.nhmmer(spark, target, hmms).df.collect()}
    assert set(rows) == {"fwd", "rev"}
    assert abs(rows["fwd"]["ali_from"] - 701) <= 5 and abs(rows["fwd"]["ali_to"] - 760) <= 5
    assert abs(rows["rev"]["ali_from"] - 210) <= 5 and abs(rows["rev"]["ali_to"] - 151) <= 5
    with pytest.warns(UserWarning, match="falling back"):
        P.nhmmer(spark, target, hmms, thresholds=P.ThresholdOptions(cut_tc=True))


def read_profiles_schema():
    from profilum.schema import PROFILES

    return PROFILES


def nested(spark):
    from pyspark.sql import types as T

    from profilum.schema import DOMAIN

    schema = T.StructType([T.StructField("sequence_id", T.StringType()), T.StructField("hmm_name", T.StringType()), T.StructField("evalue", T.DoubleType()), T.StructField("bitscore", T.DoubleType()), T.StructField("domains", T.ArrayType(DOMAIN))])
    d = lambda s, a: (1e-5, 2e-5, s, a, a + 9, a + 1, a + 8)
    return spark.createDataFrame([("123", "m", 1e-10, 123.45, [d(30.0, 1), d(80.0, 20), d(80.0, 40)]), ("s2", "m", 3e-7, 0.5, [])], schema)


def test_results(spark, tmp_path):
    result = SearchResult(nested(spark))
    assert len(result) == 2 and result.n_domains == 3
    best = {r["sequence_id"]: r["best_domain"] for r in result.best_domains().collect()}
    assert best["123"]["env_from"] == 20 and best["s2"] is None
    result.to_csv(str(tmp_path / "r.tsv"))
    again = SearchResult.from_file(spark, str(tmp_path / "r.tsv"))
    assert again.to_dataframe().sort_values("env_from").values.tolist() == result.to_dataframe().sort_values("env_from").values.tolist() and len(again) == 1
    result.to_csv(str(tmp_path / "m.tsv"), legacy_format="memory")
    assert (tmp_path / "m.tsv").read_text().splitlines()[1].split("\t")[2:5] == ["1e-10", "123", "1e-05"]
    result.to_csv(str(tmp_path / "d.tsv"), legacy_format="disk")
    assert (tmp_path / "d.tsv").read_text().splitlines()[1].split("\t")[2:4] == ["1.00e-10", "123.45"]
    assert [r.sequence_id for r in result] == ["123", "s2"]
    hits = list(result)
    assert isinstance(hits[0], P.SequenceHit) and hits[0].best_domain == max(hits[0].domains, key=lambda d: d.bitscore) and hits[1].best_domain is None
    with P.ResultCollector(spark, str(tmp_path / "collected"), held=2) as collector:
        for hit in hits * 3 + hits[:1]:
            collector.add(hit)
    found = collector.finalize()
    assert sorted(found, key=str) == sorted(hits * 3 + hits[:1], key=str) and len(found) == 7
    with pytest.raises(RuntimeError):
        collector.add(hits[0])
    with result as kept:
        assert kept.nested.is_cached
    assert H.max_score_by_sequence(result.df).collect()[0]["max_bitscore"] == 123.45


def test_number_formats(spark):
    values = [0.0, 1.0, 0.5, 123.45, 1234.5, 0.00012345, 0.000012345, 1e-300, 99.95, 12.25, -3.14159]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", general(F.col("v")).alias("g"), scientific(F.col("v")).alias("s")).collect()
    assert [r["g"] for r in rows] == ["%.3g" % v for v in values]
    # exact ties are rounded up here and to even in C
    assert [r["s"] for r in rows if r["v"] != 12.25] == ["%.2e" % v for v in values if v != 12.25]
    assert spark.range(1).select(reverse_complement(F.lit("ACGTNry"))).first()[0] == "RYNACGT"


@pytest.fixture
def home(tmp_path, monkeypatch):
    monkeypatch.setenv(config.DATA_VARIABLE, str(tmp_path / "data"))
    monkeypatch.setenv(config.CONFIG_VARIABLE, str(tmp_path / "config"))
    config.reset_config()
    databases.reset_registry()
    yield tmp_path
    config.reset_config()
    databases.reset_registry()


def test_registry_and_installing(home, spark):
    assert len(P.list_databases()) == 14 and [d.name for d in P.list_databases(P.MoleculeType.NUCLEOTIDE)] == ["DFAM", "barrnap"]
    text = format_profile(record("K00001", FIRST))

    def fetch(url, target):
        if url.endswith("tar.gz"):
            with tarfile.open(target, "w:gz") as tar:
                for name in ("profiles/K00001.hmm", "../evil.hmm"):
                    info = tarfile.TarInfo(name)
                    info.size = len(text)
                    tar.addfile(info, io.BytesIO(text.encode()))
        elif url.endswith("ko_list.gz"):
            target.write_bytes(gzip.compress(b"knum\tthreshold\nK00001\t55.5\nK00002\t-\nK00003\tabc\n"))
        elif "api.github.com" in url:
            target.write_text(json.dumps([{"name": "a.hmm", "download_url": "raw/a.hmm"}, {"name": "b.txt", "download_url": "raw/b"}]))
        else:
            target.write_text(text)

    path = P.install_database("KOFAM", fetch=fetch)
    assert not (home / "data/evil.hmm").exists()
    row = read_profiles(spark, str(path)).first()
    assert row["ga"]["seq"] == row["nc"]["dom"] == 55.5
    assert sorted(p.name for p in P.install_database("PADLOC", fetch=fetch).iterdir()) == ["a.hmm"]
    databases.reset_registry()
    assert [d.name for d in P.list_databases(installed_only=True)] == ["KOFAM", "PADLOC"]
    own = home / "mine"
    own.mkdir()
    P.register_custom_database("mine", str(own), P.MoleculeType.PROTEIN, "me")
    with pytest.raises(ValueError):
        P.register_custom_database("mine", str(own), "protein")
    databases.reset_registry()
    assert P.get_registry().get("mine").citation == "me"
    P.uninstall_database("mine")
    P.uninstall_database("KOFAM")
    assert own.exists() and not path.exists() and P.get_registry().get("KOFAM").installed is False
    with pytest.raises(ValueError):
        P.install_database("nothing")


def test_addresses_of_repository_pages():
    assert databases.github_address("https://github.com/a/b/blob/v1.2/x/y.hmm") == ("https://raw.githubusercontent.com/a/b/v1.2/x/y.hmm", "y.hmm")
    assert databases.github_address("https://github.com/a/b/tree/dev/x/") == ("https://api.github.com/repos/a/b/contents/x?ref=dev", None)
    assert databases.github_address("https://github.com/a/b") == ("https://api.github.com/repos/a/b/contents", None)


def test_command_line(spark, files, home, capsys):
    assert cli.main([]) == 1
    assert cli.main(["search", "-s", str(files / "p.faa"), "-H", str(files / "two.hmm"), "-o", str(home / "out"), "--incE", "1e-3"]) == 0
    lines = (home / "out/search_results.tsv").read_text().splitlines()
    assert lines[0].split("\t") == RESULT.fieldNames() and len(lines) == 4
    assert "Found 3 hits" in capsys.readouterr().out
    assert cli.main(["scan", "-s", "nowhere", "-H", str(files / "two.hmm"), "-o", "x.tsv"]) == 1
    assert cli.output_of("name", "scan").name == "scan_results.tsv" and cli.output_of("hits.domtbl", "scan").name == "hits.domtbl"
    options = dict(threads=2, output_dir=str(home / "kept"), show_progress=False)
    result = P.search(spark, str(files / "p.faa"), str(files / "two.hmm"), thresholds=P.ThresholdOptions(inc_evalue=1e-3), **options)
    assert len(result) == 3 and result.nested.inputFiles()[0].startswith(f"file://{home}/kept/search-")
    with pytest.raises(ValueError):
        P.scan(spark, str(files / "p.faa"), str(files / "two.hmm"), threads=-1)
    assert cli.main(["db", "list", "--type", "nucleotide"]) == 0
    assert "barrnap" in capsys.readouterr().out


def test_stream(spark, files, tmp_path):
    from profilum.streaming.files import stream_search

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.faa").write_text((files / "p.faa").read_text())
    query = stream_search(spark, str(tmp_path / "in"), str(files / "two.hmm"), str(tmp_path / "out"), str(tmp_path / "check"), z=4)
    query.awaitTermination(120)
    assert {r["sequence_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b", "d"}
