"""Profile files (HMMER3 ASCII) as DataFrames, and back."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.schema import PROFILES
from profilum.sources.files import listed

log = logging.getLogger(__name__)

SUFFIXES = (".hmm",)
_TEXT = {"NAME": "name", "ACC": "accession", "DESC": "description"}
_NUMBERS = {"LENG": ("model_length", int), "MAXL": ("max_length", int), "NSEQ": ("nseq", int), "EFFN": ("effn", float), "CKSUM": ("cksum", int)}
_STATS = {"MSV": ("stats_msv", "mu"), "VITERBI": ("stats_viterbi", "mu"), "FORWARD": ("stats_forward", "tau")}


def _values(fields: list[str]) -> list[float | None]:
    return [None if f == "*" else float(f) for f in fields]


def parse_profile(record: str) -> dict:
    """One record; anything missing or malformed raises ValueError."""
    lines = [line for line in record.replace("\r", "").split("\n") if line.strip()]
    if not lines or not lines[0].startswith("HMMER3/"):
        raise ValueError("not a HMMER3 profile")
    out: dict = {f: None for f in PROFILES.fieldNames()} | {"format_version": lines[0].split()[0], "compo": None}
    at = 1
    while at < len(lines) and not lines[at].startswith("HMM "):
        tag, _, rest = lines[at].partition(" ")
        rest = rest.strip()
        if tag in _TEXT:
            out[_TEXT[tag]] = rest
        elif tag in _NUMBERS:
            name, kind = _NUMBERS[tag]
            out[name] = kind(rest)
        elif tag == "ALPH":
            out["alphabet"] = rest.lower()
        elif tag in ("GA", "TC", "NC"):
            pair = rest.rstrip(";").split()
            out[tag.lower()] = {"seq": float(pair[0]), "dom": float(pair[1] if len(pair) > 1 else pair[0])}
        elif tag == "STATS":
            _, kind, first, second = rest.split()
            name, where = _STATS[kind]
            out[name] = {where: float(first), "lambda": float(second)}
        at += 1
    if out["name"] is None or not out["model_length"] or out["alphabet"] is None or at + 2 > len(lines):
        raise ValueError("profile header incomplete")
    at += 2
    body = [line.split() for line in lines[at:]]
    if body and body[0][0] == "COMPO":
        out["compo"] = _values(body[0][1:])
        body = body[1:]
    k = {"amino": 20, "dna": 4, "rna": 4}.get(out["alphabet"])
    m = out["model_length"]
    if k is None or len(body) < 2 + 3 * m:
        raise ValueError(f"profile {out['name']} cut short")
    out["insert_nlog"], out["trans_nlog"], out["match_nlog"] = [_values(body[0][:k])], [_values(body[1][:7])], []
    consensus, columns = "", []
    for node in range(m):
        match, insert, trans = body[2 + 3 * node : 5 + 3 * node]
        if match[0] != str(node + 1) or len(match) < k + 1 or len(insert) < k or len(trans) < 7:
            raise ValueError(f"profile {out['name']}: node {node + 1} malformed")
        out["match_nlog"].append(_values(match[1 : k + 1]))
        out["insert_nlog"].append(_values(insert[:k]))
        out["trans_nlog"].append(_values(trans[:7]))
        columns.append(int(match[k + 1]) if len(match) > k + 1 and match[k + 1].isdigit() else None)
        consensus += match[k + 2] if len(match) > k + 2 else "-"
    out["consensus"], out["map"] = consensus, columns
    return out


def format_profile(row) -> str:
    """The record of a row of the profile table."""
    number = lambda v: "*" if v is None else f"{v:.5f}"
    letters = "ACDEFGHIKLMNPQRSTVWY" if row["alphabet"] == "amino" else "ACGU" if row["alphabet"] == "rna" else "ACGT"
    lines = [row["format_version"] or "HMMER3/f", f"NAME  {row['name']}"]
    lines += [f"{tag:<5} {row[c]}" for tag, c in (("ACC", "accession"), ("DESC", "description")) if row[c]]
    lines.append(f"LENG  {row['model_length']}")
    if row["max_length"]:
        lines.append(f"MAXL  {row['max_length']}")
    lines += [f"ALPH  {row['alphabet'].upper() if row['alphabet'] != 'amino' else 'amino'}", "RF    no", "MM    no", "CONS  yes", "CS    no", "MAP   yes"]
    lines += [f"{tag:<5} {row[c]}" for tag, c in (("NSEQ", "nseq"), ("EFFN", "effn"), ("CKSUM", "cksum")) if row[c] is not None]
    lines += [f"{c.upper():<5} {row[c]['seq']:.2f} {row[c]['dom']:.2f};" for c in ("ga", "tc", "nc") if row[c] is not None]
    lines += [f"STATS LOCAL {kind} {row[c][where]:.4f} {row[c]['lambda']:.5f}" for kind, (c, where) in _STATS.items() if row[c] is not None]
    lines += ["HMM   " + "        ".join(letters), "      m->m m->i m->d i->m i->i d->m d->d"]
    if row["compo"] is not None:
        lines.append("  COMPO " + " ".join(map(number, row["compo"])))
    for node in range(row["model_length"] + 1):
        if node:
            column = row["map"][node - 1] if row["map"] and row["map"][node - 1] is not None else "-"
            lines.append(f"  {node} " + " ".join(map(number, row["match_nlog"][node - 1])) + f" {column} {(row['consensus'] or '-' * node)[node - 1]} - - -")
        lines += ["  " + " ".join(map(number, row["insert_nlog"][node])), "  " + " ".join(map(number, row["trans_nlog"][node]))]
    return "\n".join(lines) + "\n//\n"


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profile files, one a partition, in a new folder."""

    whole = ("nseq", "cksum", "max_length", "model_length")

    def plain(value):
        """Lists and None for what Arrow gives as arrays and NaN."""
        if isinstance(value, (list, np.ndarray)):
            return [plain(v) for v in value]
        return value if isinstance(value, dict) or not pd.isna(value) else None

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{k: plain(v) for k, v in row.items()} for row in batch.to_dict("records")]
            yield pd.DataFrame({"value": [format_profile(row | {c: None if row[c] is None else int(row[c]) for c in whole}).removesuffix("\n") for row in rows]})

    profiles.mapInPandas(text, "value string").write.text(path)


def read_profiles(spark: SparkSession, source: str | list[str] | DataFrame) -> DataFrame:
    """Profiles of a file (any number of records), a folder of .hmm files, several of them, or rows already there.

    A file that is empty or malformed is an error; in a folder it is left out
    with a warning.  ``profile_index`` tells profiles apart within a call.
    """
    if isinstance(source, DataFrame):
        return source
    paths = [source] if isinstance(source, str) else [str(s) for s in source]
    strict, lenient = [], []
    for path in paths:
        files, folder = listed(spark, path, SUFFIXES)
        if folder and not files:
            raise ValueError(f"no profile files in {path}")
        for name, size in files:
            if size:
                (lenient if folder else strict).append(name)
            elif folder:
                log.warning("skipping empty profile file %s", name)
            else:
                raise ValueError(f"empty profile file: {name}")
    names = strict + lenient
    if not names:
        raise ValueError("no profile file")
    permissive = set(lenient)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, path, at in zip(batch["value"], batch["source_path"], batch["at"]):
                text = value.strip("\n ")
                if text in ("", "//"):
                    continue
                try:
                    rows.append(parse_profile(text.removesuffix("//")) | {"source_path": path, "profile_index": at})
                except (ValueError, IndexError, KeyError):
                    if path not in permissive:
                        raise
                    rows.append({f: None for f in PROFILES.fieldNames()} | {"source_path": path, "profile_index": -1})
            yield pd.DataFrame(rows, columns=PROFILES.fieldNames())

    raw = spark.read.option("lineSep", "\n//\n").text(names).select("value", F.col("_metadata.file_path").alias("source_path"))
    numbered = raw.withColumn("at", F.monotonically_increasing_id())
    parsed = numbered.mapInPandas(parse, PROFILES)
    if lenient:
        bad = [r[0] for r in parsed.where("profile_index = -1").select("source_path").distinct().collect()]
        for name in bad:
            log.warning("skipping unreadable profile file %s", name)
        parsed = parsed.where(~F.col("source_path").isin(bad)) if bad else parsed
    return parsed
