"""FASTA files as DataFrames."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.functions.residues import AMINO, AMINO_DEGENERATE, DNA, DNA_DEGENERATE, NONRESIDUES
from profilum.options import MoleculeType
from profilum.schema import SEQUENCES
from profilum.sources.files import listed

log = logging.getLogger(__name__)

SUFFIXES = (".faa", ".fna", ".fa", ".fasta", ".fas")
MEMORY = "<memory>"


def symbols(alphabet: str) -> str:
    """All letters that a sequence may hold, upper case, and the signs that match nothing."""
    canonical, degenerate = (AMINO, AMINO_DEGENERATE) if alphabet == "amino" else (DNA + "U", DNA_DEGENERATE)
    return canonical + "".join(degenerate) + NONRESIDUES


def alphabet_of(molecule_type: MoleculeType | str) -> str:
    kind = molecule_type.value if isinstance(molecule_type, MoleculeType) else molecule_type
    return {"protein": "amino", "nucleotide": "dna"}[kind]


def _illegal(residues: Column, alphabet: str) -> Column:
    allowed = "".join("\\" + c if c in "-.*~_" else c + c.lower() for c in symbols(alphabet))
    return residues.rlike(f"[^{allowed}]")


def read_sequences(spark: SparkSession, source: str | list[str] | DataFrame, molecule_type: MoleculeType | str = MoleculeType.PROTEIN, alphabet: str | None = None) -> DataFrame:
    """Sequences of a file, a folder, several of them, or rows already there; lazy but for the checks below.

    A file that is empty or isn't FASTA of the alphabet is an error; in a
    folder such a file is left out with a warning, and it is an error if none
    is left.  ``record_index`` grows in file order.
    """
    alphabet = alphabet or alphabet_of(molecule_type)
    if isinstance(source, DataFrame):
        return from_rows(source, alphabet)
    paths = [source] if isinstance(source, str) else [str(s) for s in source]
    strict, lenient = [], []
    for path in paths:
        files, folder = listed(spark, path, SUFFIXES)
        if folder and not files:
            raise ValueError(f"no sequence files in {path}")
        for name, size in files:
            if size:
                (lenient if folder else strict).append(name)
            elif folder:
                log.warning("skipping empty sequence file %s", name)
            else:
                raise ValueError(f"empty sequence file: {name}")
    parts = []
    if strict:
        rows = _records(spark, strict, alphabet)
        message = F.concat(F.lit(f"not {alphabet} FASTA: "), "source_path", F.lit(" "), "sequence_id")
        parts.append(rows.withColumn("residues", F.when(F.col("_bad"), F.raise_error(message).cast("string")).otherwise(F.col("residues"))))
    if lenient:
        rows = _records(spark, lenient, alphabet)
        # one row a file at most
        bad = [r[0] for r in rows.where("_bad").select("source_path").distinct().collect()]
        for name in bad:
            log.warning("skipping unreadable sequence file %s", name)
        if len(bad) == len(lenient) and not strict:
            raise ValueError("no readable sequence file")
        parts.append(rows.where(~F.col("source_path").isin(bad)) if bad else rows)
    if not parts:
        raise ValueError("no readable sequence file")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*SEQUENCES.fieldNames())


def _records(spark: SparkSession, paths: list[str], alphabet: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("at"))
    # a column of its own: inside an expression that may be cut short, the counter would not count every row
    raw = raw.withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    header = F.regexp_extract("value", r"^>?([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    row = F.col("row")
    parsed = raw.select(
        "source_path",
        (F.shiftleft("at", 20) + row).alias("record_index"),
        F.regexp_extract(header, r"^\s*(\S*)", 1).alias("sequence_id"),
        F.nullif(F.trim(F.regexp_extract(header, r"^\s*\S*\s+(.*)$", 1)), F.lit("")).alias("description"),
        body.alias("residues"),
        (F.startswith("value", F.lit(">")) | (F.col("at") > 0) | (row > 0)).alias("_opened"),
    )
    return parsed.withColumns({"length": F.length("residues"), "alphabet": F.lit(alphabet), "_bad": _illegal(F.col("residues"), alphabet) | ~F.col("_opened") | (F.col("sequence_id") == "")})


def from_rows(rows: DataFrame, alphabet: str) -> DataFrame:
    """Rows with sequence_id and residues at least; what else belongs to a sequence is filled in."""
    have = set(rows.columns)
    fill = {"source_path": F.lit(MEMORY), "record_index": F.monotonically_increasing_id(), "description": F.lit(None).cast("string"), "length": F.length("residues"), "alphabet": F.lit(alphabet)}
    return rows.withColumns({k: v for k, v in fill.items() if k not in have}).select(*(F.col(f.name).cast(f.dataType) for f in SEQUENCES.fields))


def from_list(spark: SparkSession, items: list[tuple[str, str]], alphabet: str = "amino") -> DataFrame:
    """(id, residues) pairs."""
    return spark.createDataFrame([(MEMORY, i, a, None, r, len(r), alphabet) for i, (a, r) in enumerate(items)], SEQUENCES)


def write_sequences(sequences: DataFrame, path: str, width: int = 60) -> None:
    """FASTA with wrapped lines, one file a partition, in a new folder; what it lacks is the sequences' source and number."""
    header = F.concat(F.lit(">"), "sequence_id", F.coalesce(F.concat(F.lit(" "), "description"), F.lit("")))
    body = F.nullif(F.regexp_replace("residues", f"(.{{{width}}})(?=.)", "$1\n"), F.lit(""))
    sequences.select(F.concat_ws("\n", header, body)).write.text(path)


def single_file(sequences: DataFrame, what: str) -> DataFrame:
    """The sequences, if they come from one file."""
    if len(sequences.select("source_path").distinct().take(2)) > 1:
        raise ValueError(f"the {what} must be a single file")
    return sequences
