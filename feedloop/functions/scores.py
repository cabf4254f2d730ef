"""Scores of the item policies at a frozen state, as column expressions.

n: feedback of the item; mean, s: mean and sum of its values; t: feedback of all items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ucb1(mean: Column, n: Column, t: Column) -> Column:
    return mean + F.sqrt(2.0 * F.ln(t + 1) / n)


def ucb1_tuned(mean: Column, squares: Column, n: Column, t: Column) -> Column:
    """squares: sum of squared deviations from the mean, not divided by n."""
    spread = squares - mean * mean + F.sqrt(2.0 * F.ln(t + 1) / n)
    return mean + F.sqrt(F.ln(t + 1) / n * F.least(F.lit(0.25), spread))


def beta_mean(s: Column, n: Column, alpha: float, beta: float) -> Column:
    """Mean of the posterior of Thompson sampling."""
    return (s + alpha) / (n + alpha + beta)


def moving(values: Column, rate: float) -> Column:
    """Exponential moving value from 0 over an ordered array of values."""
    return F.aggregate(values, F.lit(0.0), lambda old, r: old + rate * (r - old))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def one_hot(present: Column, low: int, high: int) -> Column:
    """A string of 0 and 1 that tells which codes from low to high an array holds."""
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda c: F.when(F.array_contains(present, c), "1").otherwise("0")), "")
