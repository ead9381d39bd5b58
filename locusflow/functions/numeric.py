"""Numeric expressions that Spark does not give as they are needed here."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """Floating division with x/0 = +-Infinity and 0/0 = NaN; null if either side is."""
    a, b = a.cast("double"), b.cast("double")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | F.isnan(b), F.lit(float("nan")))
        .when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    )


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def link(x: Column, denominator: float) -> tuple[Column, Column, Column]:
    """Heritability link, and its first and second derivative factors."""
    p = logistic(x)
    return softplus(x) / denominator, p / denominator, p * (1 - p) / denominator


def frequency_term(p: Column, alpha: float) -> Column:
    return 2 * p * F.pow(1 - p, F.lit(1.0 + alpha))


def log10_two_sided(z: float) -> float:
    """log10 of the two-sided normal tail, with the asymptotic series far out."""
    z = abs(z)
    if math.isnan(z):
        return float("nan")
    if z < 30:
        return math.log10(math.erfc(z / math.sqrt(2)))
    s = 1 - 1 / z**2 + 3 / z**4 - 15 / z**6
    return (-z * z / 2 - math.log(z) - 0.5 * math.log(2 * math.pi) + math.log(s) + math.log(2)) / math.log(10)


def jackknife_group(ordinal: Column, n_blocks: int, n_groups: int) -> Column:
    """Contiguous groups of blocks; the first ones take one block more each."""
    q, r = divmod(n_blocks, min(n_groups, n_blocks) or 1)
    wide = r * (q + 1)
    return F.when(ordinal < wide, F.floor(ordinal / (q + 1))).otherwise(r + F.floor((ordinal - wide) / q)).cast("long")
