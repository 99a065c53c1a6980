"""Queries over the driver's tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.functions.residues import AMINO, composition, digitize, reverse_complement
from profilum.functions.stats import evalue, general, gumbel_lnp, log10_evalue, scientific, tail_lnp
from profilum.kernel.build import conditional, uncalibrated
from profilum.kernel.model import background
from profilum.manifest import DATABASES
from profilum.operators import hits as H
from profilum.operators import registry as R
from profilum.operators import seeds as W
from profilum.operators import thresholds as TH
from profilum.operators.result import SearchResult
from profilum.options import DEFAULTS, ThresholdOptions
from profilum.plans import score as S
from profilum.plans.corpus import profiles, queries_of, sequences, table
from profilum.schema import PROFILES
from profilum.sources.fasta import from_rows, read_sequences, write_sequences
from profilum.sources.files import parts
from profilum.sources.profiles import read_profiles, write_profiles
from profilum.sources.tables import kept, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------------ SQL twins

_LETTERS = "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]"
_SEQS = f"seqs AS (SELECT source AS source_path, doc_id AS record_index, 'doc' || doc_id AS sequence_id, upper(regexp_replace(coalesce(text, ''), '{_LETTERS}', '', 'g')) AS residues FROM documents)"
_PROFS = f"""profs AS (SELECT item_id AS profile_index, 'bm' || item_id AS hmm_name, upper(regexp_replace(coalesce(text, ''), '{_LETTERS}', '', 'g')) AS residues,
  CASE WHEN item_id % 2 = 0 THEN 30.0 END AS ga, CASE WHEN item_id % 3 = 0 THEN 40.0 END AS tc, CASE WHEN item_id % 5 = 0 THEN 24.0 END AS nc FROM benchmark)"""
_SEGMENTS = f"""{_SEQS}, {_PROFS},
sw AS (SELECT record_index, i, substr(residues, i, 8) AS w FROM (SELECT *, unnest(range(1, length(residues) - 6)) AS i FROM seqs WHERE length(residues) >= 8)),
pw AS (SELECT profile_index, i, substr(residues, i, 8) AS w FROM (SELECT *, unnest(range(1, length(residues) - 6)) AS i FROM profs WHERE length(residues) >= 8)),
m AS (SELECT profile_index, record_index, sw.i AS pos, sw.i - pw.i AS diagonal FROM sw JOIN pw USING (w)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY profile_index, record_index, diagonal ORDER BY pos) AS g FROM m),
rn AS (SELECT profile_index, record_index, diagonal, min(pos) AS a, max(pos) + 7 AS b FROM isl GROUP BY profile_index, record_index, diagonal, g),
ga AS (SELECT *, (b - a + 1) * 5 AS gain, coalesce(a - lag(b) OVER w - 1, 0) * 4 AS loss FROM rn WINDOW w AS (PARTITION BY profile_index, record_index, diagonal ORDER BY a)),
su AS (SELECT *, sum(gain - loss) OVER w AS s, sum(gain - loss) OVER w - gain AS base FROM ga WINDOW w AS (PARTITION BY profile_index, record_index, diagonal ORDER BY a ROWS UNBOUNDED PRECEDING)),
lo AS (SELECT *, min(base) OVER w AS low, min(base * 1000000000 + a) OVER w - min(base) OVER w * 1000000000 AS first FROM su WINDOW w AS (PARTITION BY profile_index, record_index, diagonal ORDER BY a ROWS UNBOUNDED PRECEDING)),
seg AS (
  SELECT profile_index, record_index, diagonal, CAST(s - low AS BIGINT) AS score, CAST(first AS INTEGER) AS seq_from, CAST(b AS INTEGER) AS seq_to, CAST(first - diagonal AS INTEGER) AS hmm_from, CAST(b - diagonal AS INTEGER) AS hmm_to
  FROM (SELECT *, row_number() OVER (PARTITION BY profile_index, record_index, diagonal ORDER BY s - low DESC, b) AS n FROM lo) WHERE n = 1)"""
_RAW = f"""{_SEGMENTS},
dom AS (SELECT *, score * 0.5 AS dscore, least(-0.7 * (score * 0.5 - 10.0), 0.0) AS dlnp FROM seg),
raw AS (
  SELECT source_path, h.record_index, sequence_id, h.profile_index, hmm_name, ga, tc, nc, seq_score, least(-0.7 * (seq_score - 10.0), 0.0) AS seq_lnp
  FROM (SELECT profile_index, record_index, max(dscore) AS seq_score FROM dom GROUP BY ALL) h JOIN seqs USING (record_index) JOIN profs USING (profile_index)),
zf AS (SELECT source_path, count(*) AS z FROM seqs GROUP BY source_path)"""


def _passes(score: str, value: str, cutoff: str | None, least: float | None, most: float | None, default: float) -> str:
    numeric = f"{score} >= {least}" if least is not None else f"{value} <= {default if most is None else most}"
    return f"CASE WHEN {cutoff} IS NOT NULL THEN {score} >= {cutoff} ELSE {numeric} END" if cutoff else f"({numeric})"


def _hits_sql(o: ThresholdOptions, z: str = "zf", unit: str = "profile_index, source_path") -> str:
    """CTEs ending in hit (included sequence hits) and hd (their reported domains)."""
    cut = {"gathering": "ga", "trusted": "tc", "noise": "nc"}[o.cutoff.value] if o.cutoff else "coalesce(tc, ga, nc)" if o.cascade else None
    join = "JOIN zf USING (source_path)" if z == "zf" else f"CROSS JOIN ({z}) AS zz(z)"
    return f"""WITH {_RAW},
e AS (SELECT *, exp(seq_lnp) * z AS evalue FROM raw {join}),
r AS (SELECT *, {_passes("seq_score", "evalue", cut, o.bitscore, o.evalue, DEFAULTS["evalue"])} AS rep FROM e),
q AS (SELECT *, sum(CAST(rep AS BIGINT)) OVER (PARTITION BY {unit}) AS dom_z, rep AND {_passes("seq_score", "evalue", cut, o.inc_bitscore, o.inc_evalue, DEFAULTS["inc_evalue"])} AS inc FROM r),
hit AS (SELECT * FROM q WHERE inc),
hv AS (SELECT hit.*, dscore, exp(dlnp) * z AS i_evalue, exp(dlnp) * dom_z AS c_evalue, seq_from, seq_to, d.hmm_from, d.hmm_to FROM hit JOIN dom d USING (profile_index, record_index)),
hd AS (SELECT *, rep AND {_passes("dscore", "i_evalue", f"({cut}) / 2" if cut else None, o.inc_dom_bitscore, o.inc_dom_evalue, DEFAULTS["inc_dom_evalue"])} AS dom_inc
  FROM hv WHERE rep AND {_passes("dscore", "i_evalue", f"({cut}) / 2" if cut else None, o.dom_bitscore, o.dom_evalue, DEFAULTS["dom_evalue"])})
"""


_FLAT = """SELECT sequence_id, hmm_name, round(log10(evalue), 6) AS log_evalue, CAST(seq_score AS DOUBLE) AS bitscore, round(log10(c_evalue), 6) AS log_c, round(log10(i_evalue), 6) AS log_i,
  CAST(dscore AS DOUBLE) AS dom_bitscore, seq_from AS env_from, seq_to AS env_to, seq_from AS ali_from, seq_to AS ali_to FROM hd"""


# ------------------------------------------------------------------ plans


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.raw_hits(profiles(spark, sf_dir), sequences(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str, options: ThresholdOptions | None = None, z: float | None = None) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    found = H.with_space(W.raw_hits(profiles(spark, sf_dir), seqs), H.space_by_file(seqs) if z is None else z)
    return H.thresholded(found, profiles(spark, sf_dir), options or ThresholdOptions(), ["profile_index", "source_path"])


def flat(spark: SparkSession, sf_dir: str, options: ThresholdOptions | None = None) -> DataFrame:
    """The flat view with E-values as rounded logarithms, as engines differ in the last digit."""
    return _rounded(H.flat(H.nested(hits(spark, sf_dir, options))))


def _rounded(rows: DataFrame) -> DataFrame:
    log = {"log_evalue": "evalue", "log_c": "c_evalue", "log_i": "i_evalue"}
    return rows.select("sequence_id", "hmm_name", *(F.round(F.log10(c), 6).alias(n) for n, c in log.items()), "bitscore", "dom_bitscore", "env_from", "env_to", "ali_from", "ali_to")


@query("digitize_residues", f"""WITH {_SEQS} SELECT sequence_id, CAST(length(residues) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(string_split(residues, ''), lambda c, i: (instr('{AMINO}', c) - 1) * i)), 0) AS BIGINT) AS checksum FROM seqs""")
def digitize_residues(spark, sf_dir):
    codes = F.filter(digitize(F.col("residues"), "amino"), lambda c: c >= 0)
    weighed = F.aggregate(F.transform(codes, lambda c, i: c.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return sequences(spark, sf_dir).select("sequence_id", F.length("residues").cast("long").alias("n"), weighed.alias("checksum"))


@query("residue_composition", f"WITH {_SEQS} SELECT sequence_id, " + ", ".join(f"CAST(length(residues) - length(replace(residues, '{c}', '')) AS BIGINT) AS n_{c}" for c in AMINO) + " FROM seqs")
def residue_composition(spark, sf_dir):
    return sequences(spark, sf_dir).select("sequence_id", *composition(F.col("residues"), "amino"))


@query("revcomp", "SELECT 'doc' || doc_id AS sequence_id, reverse(translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')), 'ACGT', 'TGCA')) AS other FROM documents")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir, "dna").select("sequence_id", reverse_complement(F.col("residues")).alias("other"))


@query("ungapped_segments", f"WITH {_SEGMENTS} SELECT profile_index, record_index, diagonal, score, seq_from, seq_to, hmm_from, hmm_to FROM seg")
def ungapped_segments(spark, sf_dir):
    return W.segments(W.matches(profiles(spark, sf_dir), sequences(spark, sf_dir))).drop("source_path")


@query("ungapped_best", f"WITH {_RAW} SELECT sequence_id, hmm_name, CAST(seq_score AS DOUBLE) AS seq_score, round(CAST(seq_lnp AS DOUBLE), 9) AS seq_lnp FROM raw")
def ungapped_best(spark, sf_dir):
    return raw(spark, sf_dir).select("sequence_id", "hmm_name", "seq_score", F.round("seq_lnp", 9).alias("seq_lnp"))


@query("space_size_by_file", "SELECT source AS source_path, count(*) AS z FROM documents GROUP BY source")
def space_size_by_file(spark, sf_dir):
    return H.space_by_file(sequences(spark, sf_dir))


@query("evalue_file_scope", f"WITH {_RAW} SELECT sequence_id, hmm_name, round(seq_lnp / ln(10.0) + log10(z), 6) AS log_evalue FROM raw JOIN zf USING (source_path)")
def evalue_file_scope(spark, sf_dir):
    found = H.with_space(raw(spark, sf_dir), H.space_by_file(sequences(spark, sf_dir)))
    return found.select("sequence_id", "hmm_name", F.round(log10_evalue(F.col("seq_lnp"), F.col("z")), 6).alias("log_evalue"))


@query("evalue_corpus_scope", f"WITH {_RAW} SELECT sequence_id, hmm_name, round(log10(exp(seq_lnp) * (SELECT count(*) FROM documents)), 6) AS log_evalue FROM raw")
def evalue_corpus_scope(spark, sf_dir):
    found = H.with_space(raw(spark, sf_dir), table(spark, sf_dir, "documents").count())
    return found.select("sequence_id", "hmm_name", F.round(F.log10(evalue(F.col("seq_lnp"), F.col("z"))), 6).alias("log_evalue"))


@query("score_pvalues", f"WITH {_RAW} SELECT sequence_id, hmm_name, round(least(-0.7 * (seq_score - 12.0), 0.0), 8) AS tail, round(CASE WHEN -0.7 * (seq_score - 12.0) < -15 THEN -0.7 * (seq_score - 12.0) ELSE ln(1 - exp(-exp(-0.7 * (seq_score - 12.0)))) END, 5) AS gumbel FROM raw")
def score_pvalues(spark, sf_dir):
    s, mu, lam = F.col("seq_score"), F.lit(12.0), F.lit(0.7)
    return raw(spark, sf_dir).select("sequence_id", "hmm_name", F.round(tail_lnp(s, mu, lam), 8).alias("tail"), F.round(gumbel_lnp(s, mu, lam), 5).alias("gumbel"))


#: Options whose effect each query shows.
_CASES = {
    "thr_E": ThresholdOptions(evalue=1e-6), "thr_T": ThresholdOptions(bitscore=30.0), "thr_domE": ThresholdOptions(dom_evalue=1e-5), "thr_domT": ThresholdOptions(dom_bitscore=28.0),
    "thr_incE": ThresholdOptions(inc_evalue=1.0), "thr_incT": ThresholdOptions(inc_bitscore=24.0),
    "cut_ga": ThresholdOptions(cut_ga=True), "cut_tc": ThresholdOptions(cut_tc=True), "cut_nc": ThresholdOptions(cut_nc=True), "cascade": ThresholdOptions(cascade=True), "flat_result": ThresholdOptions(),
}
for _name, _options in _CASES.items():
    query(_name, _hits_sql(_options) + _FLAT)(functools.partial(flat, options=_options))


#: Options that flag domains and drop none.
_FLAGS = {"thr_incdomE": ThresholdOptions(inc_dom_evalue=1e-6), "thr_incdomT": ThresholdOptions(inc_dom_bitscore=26.0)}


def flagged(spark: SparkSession, sf_dir: str, options: ThresholdOptions) -> DataFrame:
    """Reported domains of included hits, and whether each is included itself."""
    kept = hits(spark, sf_dir, options).where("seq_included").select("sequence_id", "hmm_name", F.explode(F.filter("domains", lambda d: d["reported"])).alias("d"))
    return kept.select("sequence_id", "hmm_name", F.col("d.score").alias("dom_bitscore"), F.col("d.env_from").alias("env_from"), F.col("d.env_to").alias("env_to"), F.col("d.included").alias("included"))


for _name, _options in _FLAGS.items():
    query(_name, _hits_sql(_options) + "SELECT sequence_id, hmm_name, CAST(dscore AS DOUBLE) AS dom_bitscore, seq_from AS env_from, seq_to AS env_to, dom_inc AS included FROM hd")(functools.partial(flagged, options=_options))


@query("cutoff_availability", f"WITH {_PROFS} SELECT hmm_name AS name, ga IS NOT NULL AS gathering, tc IS NOT NULL AS trusted, nc IS NOT NULL AS noise FROM profs")
def cutoff_availability(spark, sf_dir):
    return TH.cutoff_availability(profiles(spark, sf_dir))


@query("best_cutoff", f"WITH {_PROFS} SELECT hmm_name AS name, CASE WHEN tc IS NOT NULL THEN 'trusted' WHEN ga IS NOT NULL THEN 'gathering' WHEN nc IS NOT NULL THEN 'noise' END AS cutoff FROM profs")
def best_cutoff(spark, sf_dir):
    return profiles(spark, sf_dir).select("name", TH.best_cutoff().alias("cutoff"))


@query("cutoff_fallback", _hits_sql(ThresholdOptions()) + _FLAT)
def cutoff_fallback(spark, sf_dir):
    """Gathering cutoffs that some profile lacks: the E-values rule."""
    return flat(spark, sf_dir, TH.require_cutoff(profiles(spark, sf_dir), ThresholdOptions(cut_ga=True), fall_back=True))


@query("included_hits", _hits_sql(ThresholdOptions()) + "SELECT sequence_id, hmm_name, round(log10(evalue), 6) AS log_evalue, CAST(seq_score AS DOUBLE) AS bitscore FROM hit")
def included_hits(spark, sf_dir):
    return H.nested(hits(spark, sf_dir)).select("sequence_id", "hmm_name", F.round(F.log10("evalue"), 6).alias("log_evalue"), "bitscore")


@query("reported_domains", _hits_sql(ThresholdOptions(dom_bitscore=25.0)) + "SELECT sequence_id, hmm_name, count(*) AS n, sum(hmm_to - hmm_from + 1)::BIGINT AS residues FROM hd GROUP BY ALL")
def reported_domains(spark, sf_dir):
    kept = hits(spark, sf_dir, ThresholdOptions(dom_bitscore=25.0)).where("seq_included").select("sequence_id", "hmm_name", F.filter("domains", lambda d: d["reported"]).alias("d")).where("size(d) > 0")
    return kept.select("sequence_id", "hmm_name", F.size("d").cast("long").alias("n"), F.aggregate("d", F.lit(0).cast("long"), lambda a, d: a + d["hmm_to"] - d["hmm_from"] + 1).alias("residues"))


@query("dedup_hits", f"WITH {_RAW} SELECT hmm_name, source_path, sequence_id, CAST(seq_score AS DOUBLE) AS seq_score FROM (SELECT *, row_number() OVER (PARTITION BY profile_index, source_path ORDER BY seq_lnp, record_index) AS n FROM raw) WHERE n = 1")
def dedup_hits(spark, sf_dir):
    return H.without_duplicates(raw(spark, sf_dir), ["profile_index", "source_path"]).select("hmm_name", "source_path", "sequence_id", "seq_score")


@query("role_swap_scan", _hits_sql(ThresholdOptions(), "SELECT count(*) FROM benchmark", "record_index") + _FLAT)
def role_swap_scan(spark, sf_dir):
    """The same scores with sequences as queries: the space is the profiles."""
    found = H.with_space(raw(spark, sf_dir), table(spark, sf_dir, "benchmark").count())
    rows = H.flat(H.nested(H.thresholded(found, profiles(spark, sf_dir), ThresholdOptions(), ["record_index"])))
    return rows.select("sequence_id", "hmm_name", F.round(F.log10("evalue"), 6).alias("log_evalue"), F.round(F.log10("c_evalue"), 6).alias("log_c"), F.round(F.log10("i_evalue"), 6).alias("log_i"), "bitscore", "dom_bitscore", "env_from", "env_to", "ali_from", "ali_to")


@query("nested_result", _hits_sql(ThresholdOptions()) + "SELECT hit.sequence_id, hit.hmm_name, count(hd.dscore) AS n_domains, CAST(coalesce(sum(hd.dscore), 0) AS DOUBLE) AS total FROM hit LEFT JOIN hd USING (profile_index, record_index) GROUP BY ALL")
def nested_result(spark, sf_dir):
    rows = H.nested(hits(spark, sf_dir))
    return rows.select("sequence_id", "hmm_name", F.size("domains").cast("long").alias("n_domains"), F.aggregate("domains", F.lit(0.0), lambda a, d: a + d["bitscore"]).alias("total"))


@query("regroup_hits", _hits_sql(ThresholdOptions()) + "SELECT sequence_id, hmm_name, CAST(max(seq_score) AS DOUBLE) AS bitscore, count(*) AS n_domains, min(seq_from) AS first FROM hd GROUP BY ALL")
def regroup_hits(spark, sf_dir):
    rows = H.regroup(H.flat(H.nested(hits(spark, sf_dir))))
    return rows.select("sequence_id", "hmm_name", "bitscore", F.size("domains").cast("long").alias("n_domains"), F.array_min(F.transform("domains", lambda d: d["env_from"])).alias("first"))


@query("best_domain", _hits_sql(ThresholdOptions()) + "SELECT hit.sequence_id, hit.hmm_name, CAST(max(hd.dscore) AS DOUBLE) AS best FROM hit LEFT JOIN hd USING (profile_index, record_index) GROUP BY ALL")
def best_domain(spark, sf_dir):
    return H.best_domain(H.nested(hits(spark, sf_dir))).select("sequence_id", "hmm_name", F.col("best_domain.bitscore").alias("best"))


@query("max_score_per_sequence", _hits_sql(ThresholdOptions()) + "SELECT sequence_id, CAST(max(seq_score) AS DOUBLE) AS max_bitscore FROM hd GROUP BY sequence_id")
def max_score_per_sequence(spark, sf_dir):
    return H.max_score_by_sequence(H.flat(H.nested(hits(spark, sf_dir))))


@query("hit_count", _hits_sql(ThresholdOptions()) + "SELECT hmm_name, count(*) AS hits FROM hit GROUP BY hmm_name")
def hit_count(spark, sf_dir):
    return H.nested(hits(spark, sf_dir)).groupBy("hmm_name").agg(F.count(F.lit(1)).alias("hits"))


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY profile_index ORDER BY seq_lnp, sequence_id, record_index) AS query_rank FROM raw"


@query("rank_hits", f"WITH {_RAW} SELECT hmm_name, sequence_id, query_rank FROM ({_RANKED})")
def rank_hits(spark, sf_dir):
    return H.ranked(raw(spark, sf_dir), ["profile_index"]).select("hmm_name", "sequence_id", F.col("query_rank").cast("long").alias("query_rank"))


@query("top_hits", f"WITH {_RAW} SELECT hmm_name, sequence_id, query_rank FROM ({_RANKED}) WHERE query_rank <= 5")
def top_hits(spark, sf_dir):
    return H.top_hits(raw(spark, sf_dir), ["profile_index"], 5).select("hmm_name", "sequence_id", F.col("query_rank").cast("long").alias("query_rank"))


@query("format_sci", f"WITH {_RAW} SELECT sequence_id, hmm_name, printf('%.2e', exp(CAST(seq_lnp AS DOUBLE))) AS sci, printf('%.3g', CAST(seq_score AS DOUBLE)) AS gen FROM raw")
def format_sci(spark, sf_dir):
    return raw(spark, sf_dir).select("sequence_id", "hmm_name", scientific(F.exp("seq_lnp")).alias("sci"), general(F.col("seq_score")).alias("gen"))


# ------------------------------------------------------------------ registry

_quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
_FIELDS = ("name", "url", "molecule_type", "domain", "has_thresholds", "citation", "notes")
_BUNDLED = "bundled(name, url, molecule_type, domain, has_thresholds, citation, notes) AS (VALUES " + ", ".join("(" + ", ".join(_quote(d[f]) for f in _FIELDS) + ")" for d in DATABASES) + ")"
_NAME = "'bm' || item_id"
_STATE = f"""state AS (
  SELECT CASE item_id % 7 WHEN 0 THEN 'PFAM' WHEN 1 THEN 'barrnap' ELSE {_NAME} END AS name, item_id % 2 = 0 AS installed, '/data/' || item_id AS path, CAST(NULL AS VARCHAR) AS version,
    item_id % 7 > 1 AND item_id % 3 > 0 AS custom, CASE WHEN item_id % 4 = 0 THEN 'nucleotide' ELSE 'protein' END AS molecule_type, CAST(NULL AS VARCHAR) AS citation
  FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN item_id % 7 < 2 THEN item_id % 7 ELSE item_id + 7 END ORDER BY item_id) AS n FROM benchmark) WHERE n = 1)"""
_MERGED = f"""WITH {_BUNDLED}, {_STATE}, merged AS (
  SELECT b.*, coalesce(s.installed, false) AS installed, s.path, s.version, false AS custom FROM bundled b LEFT JOIN state s USING (name)
  UNION ALL
  SELECT name, '' AS url, molecule_type, false, false, coalesce(citation, ''), NULL, installed, path, version, true FROM state WHERE custom AND name NOT IN (SELECT name FROM bundled))
"""


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(d[f] for f in _FIELDS) for d in DATABASES], "name string, url string, molecule_type string, domain boolean, has_thresholds boolean, citation string, notes string")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local state made of benchmark items: two bundled names, and custom and forgotten ones."""
    i = F.col("item_id")
    name = F.when(i % 7 == 0, "PFAM").when(i % 7 == 1, "barrnap").otherwise(F.concat(F.lit("bm"), i))
    rows = table(spark, sf_dir, "benchmark").select(i, name.alias("name")).groupBy("name").agg(F.min("item_id").alias("item_id"))
    none = F.lit(None).cast("string")
    return rows.select("name", (i % 2 == 0).alias("installed"), F.concat(F.lit("/data/"), i).alias("path"), none.alias("version"), ((i % 7 > 1) & (i % 3 > 0)).alias("custom"), F.when(i % 4 == 0, "nucleotide").otherwise("protein").alias("molecule_type"), none.alias("citation"))


@query("registry_merge", _MERGED + "SELECT * FROM merged")
def registry_merge(spark, sf_dir):
    return R.merge(bundled(spark), state(spark, sf_dir))


@query("registry_custom", _MERGED + "SELECT * FROM merged WHERE custom")
def registry_custom(spark, sf_dir):
    return R.merge(bundled(spark), state(spark, sf_dir)).where("custom")


@query("registry_list", _MERGED + "SELECT name, molecule_type, path FROM merged WHERE molecule_type = 'protein' AND installed")
def registry_list(spark, sf_dir):
    return R.listed(R.merge(bundled(spark), state(spark, sf_dir)), "protein", installed_only=True).select("name", "molecule_type", "path")


@query("inject_thresholds", f"""WITH {_PROFS}, side AS (SELECT 'bm' || item_id AS knum, CASE item_id % 4 WHEN 0 THEN '-' WHEN 1 THEN 'none' ELSE CAST(item_id * 1.5 AS VARCHAR) END AS threshold FROM benchmark),
told AS (SELECT knum, try_cast(threshold AS DOUBLE) AS t FROM side WHERE try_cast(threshold AS DOUBLE) IS NOT NULL)
SELECT hmm_name AS name, coalesce(t, ga)::DOUBLE AS ga, coalesce(t, tc)::DOUBLE AS tc, coalesce(t, nc)::DOUBLE AS nc, coalesce(t, ga / 2)::DOUBLE AS ga_dom FROM profs LEFT JOIN told ON knum = hmm_name""")
def inject_thresholds(spark, sf_dir):
    i = F.col("item_id")
    side = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bm"), i).alias("knum"), F.when(i % 4 == 0, "-").when(i % 4 == 1, "none").otherwise((i * F.lit(1.5)).cast("string")).alias("threshold"))
    return R.inject_thresholds(profiles(spark, sf_dir), side).select("name", *(F.col(f"{c}.seq").alias(c) for c in ("ga", "tc", "nc")), F.col("ga.dom").alias("ga_dom"))


# ------------------------------------------------------------------ kernel


def targets(spark: SparkSession, sf_dir: str, alphabet: str = "amino") -> DataFrame:
    """Benchmark items as sequences of five files: the kernel's queries compare all items with all."""
    rows = queries_of(profiles(spark, sf_dir, alphabet))
    return rows.withColumn("source_path", F.concat(F.lit("file"), F.col("record_index") % 5))


def _kernel(spark: SparkSession, sf_dir: str, alphabet: str = "amino") -> tuple[DataFrame, DataFrame]:
    """Items as calibrated profiles, packed once, and items as targets."""
    return kept(S.pack_sequences(queries_of(profiles(spark, sf_dir, alphabet)), alphabet)), targets(spark, sf_dir, alphabet)


def _msv_sql() -> str:
    """The ungapped recurrence as a recursive CTE: one step a residue, match scores as lists in single precision."""
    bg, p = background("amino"), conditional("amino")
    odds = np.log(p / bg).astype(np.float32)
    table = ", ".join(f"('{x}', [{', '.join(repr(a) for a in AMINO)}], [{', '.join(repr(float(odds[i, k])) for i in range(len(AMINO)))}])" for k, x in enumerate(AMINO))
    best = "list_transform(range(1, m + 1), lambda k: greatest(CASE WHEN k > 1 THEN ms[k - 1] ELSE low END, CAST(b + entry AS FLOAT)) + o[k])"
    return f"""WITH RECURSIVE {_PROFS},
sym AS (SELECT x, map(letters, CAST(scores AS FLOAT[])) AS mp FROM (VALUES {table}) AS v(x, letters, scores)),
q AS (SELECT profile_index, length(residues) AS m, ln(2.0::DOUBLE / (length(residues) * (length(residues) + 1))) AS entry, residues FROM profs WHERE length(residues) > 0),
po AS (SELECT profile_index, x, list_transform(string_split(residues, ''), lambda c: mp[c]) AS o FROM q, sym),
t AS (SELECT profile_index AS record_index, residues, length(residues) AS n, ln(1 - 3.0::DOUBLE / (length(residues) + 3)) AS loop, ln(3.0::DOUBLE / (length(residues) + 3)) AS move FROM profs WHERE length(residues) > 0),
r AS (
  SELECT profile_index, record_index, 0 AS i, m, n, entry, loop, move, t.residues, CAST('-inf' AS FLOAT) AS low, list_transform(range(1, m + 1), lambda k: CAST('-inf' AS FLOAT)) AS ms,
    CAST('-inf' AS DOUBLE) AS j, CAST('-inf' AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS f, move AS b FROM q, t
  UNION ALL
  SELECT profile_index, record_index, i, m, n, entry, loop, move, residues, low, new, j2, c2, f2, greatest(f2, j2) + move FROM (
    SELECT *, greatest(j + loop, e - ln(2.0::DOUBLE)) AS j2, greatest(c + loop, e - ln(2.0::DOUBLE)) AS c2, f + loop AS f2 FROM (
      SELECT *, CAST(list_max(new) AS DOUBLE) AS e FROM (
        SELECT r.profile_index, record_index, i + 1 AS i, m, n, entry, loop, move, residues, low, j, c, f, b, {best} AS new
        FROM r JOIN po ON po.profile_index = r.profile_index AND po.x = substr(residues, i + 1, 1) WHERE i < n))))
SELECT profile_index, record_index, round(c + move, 4) AS msv FROM r WHERE i = n"""


@query("msv_scores", _msv_sql())
def msv_scores(spark, sf_dir):
    """The kernel's ungapped scores of all items against each other."""
    packed, seqs = _kernel(spark, sf_dir)
    return S.filter_scores(seqs, packed).select("profile_index", "record_index", F.round("msv", 4).alias("msv"))


@query("search_full")
def search_full(spark, sf_dir):
    """Profiles against sequences through the whole cascade, spaces by file."""
    packed, seqs = _kernel(spark, sf_dir)
    found = H.with_space(S.score(seqs, packed), H.space_by_file(seqs))
    return H.flat(H.nested(H.thresholded(found, profiles(spark, sf_dir), ThresholdOptions(), ["profile_index", "source_path"])))


@query("scan_full")
def scan_full(spark, sf_dir):
    packed, seqs = _kernel(spark, sf_dir)
    found = H.with_space(S.score(seqs, packed), table(spark, sf_dir, "benchmark").count())
    return H.flat(H.nested(H.thresholded(found, profiles(spark, sf_dir), ThresholdOptions(cascade=True), ["record_index"])))


@query("phmmer_full")
def phmmer_full(spark, sf_dir):
    from profilum.plans.search import phmmer

    seqs = queries_of(profiles(spark, sf_dir))
    return phmmer(spark, queries_of(profiles(spark, sf_dir)), seqs).df


@query("jackhmmer_full")
def jackhmmer_full(spark, sf_dir):
    from profilum.plans.search import jackhmmer

    seqs = queries_of(profiles(spark, sf_dir))
    return jackhmmer(spark, queries_of(profiles(spark, sf_dir)), seqs).df


@query("nhmmer_full")
def nhmmer_full(spark, sf_dir):
    """Nucleotide letters of items against both strands of each other's."""
    packed, seqs = _kernel(spark, sf_dir, "dna")
    space = seqs.groupBy("source_path").agg((2 * F.sum("length")).alias("_residues"))
    found = S.score_nucleotides(seqs, packed).join(space, "source_path").withColumn("z", F.col("_residues") / F.col("reach"))
    return H.flat(H.nested(H.thresholded(found, profiles(spark, sf_dir, "dna"), ThresholdOptions(), ["profile_index", "source_path"])))


# ------------------------------------------------------------------ files


def _new(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _fasta(spark: SparkSession, rows: DataFrame) -> list[str]:
    """FASTA files of sequences."""
    path = _new(spark, "fasta")
    write_sequences(rows, path)
    return parts(spark, path)


def _hmm(spark: SparkSession, sf_dir: str) -> list[str]:
    """Profile files of the items."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{f: None for f in PROFILES.fieldNames()} | uncalibrated(r["name"], r["residues"], index=r["profile_index"]).to_row() | {c: r[c] for c in ("ga", "tc", "nc")} for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=PROFILES.fieldNames())

    path = _new(spark, "hmm")
    write_profiles(profiles(spark, sf_dir).where("length(residues) > 0").mapInPandas(build, PROFILES), path)
    return parts(spark, path)


_SEQUENCE = "SELECT sequence_id, {} AS description, CAST(length(residues) AS BIGINT) AS n, md5(residues) AS residues_md5 FROM seqs"


def _sequence_rows(rows: DataFrame) -> DataFrame:
    return rows.select("sequence_id", "description", F.col("length").cast("long").alias("n"), F.md5(F.col("residues").cast("binary")).alias("residues_md5"))


@query("fasta_files", f"WITH {_SEQS} " + _SEQUENCE.format("source_path"))
def fasta_files(spark, sf_dir):
    """Sequences written as FASTA and read by the reader of files."""
    return _sequence_rows(read_sequences(spark, _fasta(spark, sequences(spark, sf_dir).withColumn("description", F.col("source_path")))))


@query("sequence_rows", f"WITH {_SEQS} " + _SEQUENCE.format("CAST(NULL AS VARCHAR)"))
def sequence_rows(spark, sf_dir):
    """Sequences from rows already there."""
    return _sequence_rows(from_rows(sequences(spark, sf_dir).select("sequence_id", "residues"), "amino"))


def _profile_sql() -> str:
    """Match scores of a profile in the five decimals of a file, summed up by the letters of the item."""
    p = conditional("amino")
    letters = ", ".join(f"'{x}'" for x in AMINO)
    sums = ", ".join(repr(sum(float(f"{-np.log(v):.5f}") for v in row)) for row in p)
    return f"""WITH {_PROFS}, s AS (SELECT map([{letters}], [{sums}]) AS by_letter)
SELECT hmm_name AS name, 'amino' AS alphabet, CAST(length(residues) AS BIGINT) AS model_length, residues AS consensus, CAST(ga AS DOUBLE) AS ga, CAST(ga / 2 AS DOUBLE) AS ga_dom, CAST(tc AS DOUBLE) AS tc,
  CAST(nc AS DOUBLE) AS nc, round(list_sum(list_transform(string_split(residues, ''), lambda c: by_letter[c])), 3) AS match_sum FROM profs, s WHERE length(residues) > 0"""


@query("profile_files", _profile_sql())
def profile_files(spark, sf_dir):
    """Profiles written to files and read by the reader of files."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return read_profiles(spark, _hmm(spark, sf_dir)).select(
        "name", "alphabet", F.col("model_length").cast("long").alias("model_length"), "consensus", F.col("ga.seq").alias("ga"), F.col("ga.dom").alias("ga_dom"), F.col("tc.seq").alias("tc"), F.col("nc.seq").alias("nc"),
        F.round(F.aggregate("match_nlog", F.lit(0.0), lambda x, row: x + total(row)), 3).alias("match_sum"),
    )


@query("result_table", _hits_sql(ThresholdOptions()) + _FLAT)
def result_table(spark, sf_dir):
    """A result written as a table and read back."""
    path = _new(spark, "result")
    SearchResult(H.nested(hits(spark, sf_dir))).to_parquet(path)
    return _rounded(SearchResult.from_parquet(spark, path).df)


@query("result_tsv", _hits_sql(ThresholdOptions()) + _FLAT)
def result_tsv(spark, sf_dir):
    """The flat rows of a result as tab-separated text, read back as hits."""
    path = _new(spark, "result")
    H.flat(H.nested(hits(spark, sf_dir))).write.csv(path, sep="\t", header=True)
    return _rounded(SearchResult.from_file(spark, path).df)


@query("search_files")
def search_files(spark, sf_dir):
    """The public search: FASTA files of all items against profile files of all items."""
    from profilum.plans.search import search

    return search(spark, _fasta(spark, queries_of(profiles(spark, sf_dir))), _hmm(spark, sf_dir), z_scope="corpus").df
