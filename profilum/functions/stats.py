"""Score statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gumbel_lnp(score: Column, mu: Column, lam: Column) -> Column:
    """Natural log of P(S > score) of a Gumbel distribution; the tail is taken where 1 - exp(-y) would lose digits."""
    y = F.exp(-lam * (score - mu))
    return F.when(-lam * (score - mu) < -15, -lam * (score - mu)).otherwise(F.log(F.greatest(-F.expm1(-y), F.lit(1e-300))))


def tail_lnp(score: Column, tau: Column, lam: Column) -> Column:
    """Natural log of P(S > score) of an exponential tail, at most 0."""
    return F.least(-lam * (score - tau), F.lit(0.0))


def evalue(lnp: Column, space: Column) -> Column:
    """Expected hits of this significance in a search space."""
    return F.exp(lnp) * space


def log10_evalue(lnp: Column, space: Column) -> Column:
    """The same as a logarithm, which does not underflow."""
    return lnp / F.log(F.lit(10.0)) + F.log10(space)


def scientific(value: Column, digits: int = 2) -> Column:
    """A number as C prints it with %.<digits>e."""
    return F.format_string(f"%.{digits}e", value)


def general(value: Column, digits: int = 3) -> Column:
    """A number as C prints it with %.<digits>g: trailing zeros go, and exponents have two digits."""
    size = F.when(value == 0, F.lit(0)).otherwise(F.regexp_extract(F.format_string(f"%.{digits - 1}e", value), r"e([+-]\d+)$", 1).cast("int"))
    short = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    fixed = F.lit(None).cast("string")
    for exponent in range(-4, digits):
        fixed = F.when(size == exponent, short(F.format_string(f"%.{max(digits - 1 - exponent, 0)}f", F.bround(value, digits - 1 - exponent)))).otherwise(fixed)
    return F.when(value.isNull(), F.lit(None)).when(F.isnan(value), "nan").when((size < -4) | (size >= digits), short(F.format_string(f"%.{digits - 1}e", value))).otherwise(fixed)
