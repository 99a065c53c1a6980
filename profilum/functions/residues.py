"""Residue strings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
DNA = "ACGT"
#: One-letter codes, and what each degenerate code stands for.
AMINO_DEGENERATE = {"B": "DN", "J": "IL", "Z": "EQ", "O": "K", "U": "C", "X": AMINO}
DNA_DEGENERATE = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": DNA}
NONRESIDUES = "-.*~_"


def letters(alphabet: str) -> str:
    """Canonical letters of ``amino``, ``dna`` or ``rna``."""
    return AMINO if alphabet == "amino" else DNA if alphabet == "dna" else "ACGU"


def only_residues(text: Column, alphabet: str) -> Column:
    """The letters of a text that are residues, in upper case; filtered first, so that no other letter becomes one."""
    known = letters(alphabet)
    return F.upper(F.regexp_replace(text, f"[^{known}{known.lower()}]+", ""))


def digitize(residues: Column, alphabet: str) -> Column:
    """Residue numbers from 0, in the order of the alphabet; -1 for others."""
    return F.transform(F.split(F.upper(residues), ""), lambda c: F.instr(F.lit(letters(alphabet)), c) - 1)


def composition(residues: Column, alphabet: str) -> list[Column]:
    """Counts of each letter, one column a letter."""
    upper = F.upper(residues)
    return [(F.length(upper) - F.length(F.replace(upper, F.lit(c), F.lit("")))).cast("long").alias(f"n_{c}") for c in letters(alphabet)]


def reverse_complement(residues: Column) -> Column:
    """The other strand; degenerate codes become their complements, U counts as T."""
    return F.reverse(F.translate(F.upper(residues), "ACGTURYMKSWHBVDN", "TGCAAYRKMSWDVBHN"))
