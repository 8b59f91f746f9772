"""Beta-binomial shrinkage of rates with aggregate expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bounds of the share of variance between groups, so that a prior is never worth less than one or more than 999 rows.
LEAST_SHARE, MOST_SHARE = 0.001, 0.5


def strength_terms(n: Column, k: Column, mean: Column) -> list[Column]:
    """Sums that give the moment estimate of the variance between groups: excess of squares and its unit."""
    spread = mean * (F.lit(1.0) - mean)
    off = k - n * mean
    return [F.sum(off * off - n * spread).alias("excess"), F.sum(n * (n - F.lit(1.0)) * spread).alias("unit")]


def prior_strength(groups: DataFrame, n: str, k: str, mean: Column) -> float:
    """Rows that the prior of these groups is worth; one aggregate row reaches the driver.

    Where no group has two rows, or none has both outcomes, the estimate is
    undefined and the strongest prior is taken.
    """
    row = groups.agg(*strength_terms(F.col(n).cast("double"), F.col(k).cast("double"), mean)).first()
    share = (row.excess or 0.0) / row.unit if row.unit else 0.0
    share = min(MOST_SHARE, max(LEAST_SHARE, share))
    return 1.0 / share - 1.0


def posterior_mean(n: Column, k: Column, mean: Column, strength: float) -> Column:
    return (k + F.lit(strength) * mean) / (n + F.lit(strength))


def lower_bound(n: Column, k: Column, mean: Column, strength: float, z: float) -> Column:
    """Posterior mean less z posterior standard deviations."""
    rate = posterior_mean(n, k, mean, strength)
    return rate - F.lit(z) * F.sqrt(rate * (F.lit(1.0) - rate) / (n + F.lit(strength + 1.0)))
