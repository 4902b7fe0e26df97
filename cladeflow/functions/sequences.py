"""Sequence texts as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(seq: Column) -> Column:
    """Upper case, without white space, U as T."""
    return F.translate(F.upper(F.regexp_replace(seq, r"\s", "")), "U", "T")


def fill_overhangs(seq: Column, ambiguous: str = "N") -> Column:
    """Gaps at either end become the ambiguous letter; a sequence of gaps only becomes all ambiguous."""
    lead = F.length(seq) - F.length(F.regexp_replace(seq, "^-+", ""))
    trail = F.when(lead == F.length(seq), 0).otherwise(F.length(seq) - F.length(F.regexp_replace(seq, "-+$", "")))
    middle = F.substring(seq, lead + 1, F.length(seq) - lead - trail)
    return F.concat(F.repeat(F.lit(ambiguous), lead), middle, F.repeat(F.lit(ambiguous), trail))


def states(seq: Column) -> Column:
    """Array of single letters."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def nucleotide_letters(seq: Column) -> Column:
    """Number of letters out of A C G T - N."""
    return F.length(seq) - F.length(F.regexp_replace(seq, "[ACGTacgtN-]", ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing and compared sites of two equally long letter arrays, gaps and N left out."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isin("N", "-") | y.isin("N", "-"), F.lit(0)).when(x == y, 1).otherwise(2))
    return F.struct(F.size(F.filter(both, lambda v: v == 2)).alias("differ"), F.size(F.filter(both, lambda v: v > 0)).alias("compared"))


def jukes_cantor(p: Column, states_n: int = 4) -> Column:
    """Distance of a share p of differing sites; null where it is saturated."""
    b = 1 - 1 / states_n
    return F.when(p < b, -F.lit(b) * F.log(1 - p / b))


def equal_rates_p(t: Column, same: bool, pi: float = 0.25, rate: float = 0.75) -> Column:
    """P(i|j) after t of the equal-rate model, pi the frequency of i and rate the mean rate of W = 1."""
    e = F.exp(-t / F.lit(rate))
    return F.lit(pi) + (F.lit(1.0 if same else 0.0) - F.lit(pi)) * e


def log_factorial(k: Column) -> Column:
    """ln k! of small and large counts: exact sums below 20, Stirling's series above."""
    exact = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)])
    x = k.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(k < 20, F.get(exact, k.cast("int"))).otherwise(series)


def poisson(k: Column, mean: Column) -> Column:
    return F.exp(k * F.log(mean) - mean - log_factorial(k))
