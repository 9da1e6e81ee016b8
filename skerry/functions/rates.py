"""Rates, intervals and tests as column expressions; undefined rates are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to share."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval, within [0, 1]; nulls where n is 0 or less."""
    k, m = successes.cast("double"), F.when(n > 0, n.cast("double"))
    p, zz = k / m, z * z
    scale = 1 + zz / m
    centre = (p + zz / (2 * m)) / scale
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to about 1.2e-7 relative (Numerical Recipes' Chebyshev fit)."""
    t = 1 / (1 + x / 2)
    # fixed values: the coefficients of the fit, constant term first
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(0.0)
    for c in reversed(fit):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def mcnemar(only_a: Column, only_b: Column) -> tuple[Column, Column]:
    """Continuity-corrected statistic and p value; null without discordant pairs."""
    statistic = F.try_divide(F.pow(F.abs(only_a - only_b).cast("double") - 1, 2), (only_a + only_b).cast("double"))
    return statistic, F.when(statistic.isNotNull(), erfc(F.sqrt(F.greatest(F.lit(0.0), statistic) / 2)))
