"""Probability and scoring expressions (Column in, Column out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchgrid.settings import LOG_EPS


def prob_within(rate: Column, minutes) -> Column:
    """P(at least one event) of a Poisson process over ``minutes``."""
    return 1.0 - F.exp(-rate * minutes)


def prob_at_least(mean: Column, k: int) -> Column:
    """P(X >= k) for a Poisson variable with the given mean."""
    if k <= 0:
        return F.lit(1.0)
    below = sum(
        (F.exp(-mean) * F.pow(mean, F.lit(i)) / math.factorial(i) for i in range(k)), F.lit(0.0)
    )
    return F.greatest(F.lit(0.0), 1.0 - below)


def poisson_pmf(mean: Column, k: Column) -> Column:
    """P(X = k); ``k`` must stay within 0..20 (range of factorial)."""
    return F.exp(-mean) * F.pow(mean, k) / F.factorial(k)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def unit_scale(value: Column, low: float, high: float) -> Column:
    """Map [low, high] to [0, 1] with clamping; null counts as ``low``."""
    if high == low:
        return F.lit(0.0)
    return clip((F.coalesce(value, F.lit(low)) - low) / (high - low), 0.0, 1.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den with 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, LOG_EPS, 1.0 - LOG_EPS)
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def reliability_band(p: Column, bands: int = 10) -> Column:
    """Equal-width band index, the last band closed on the right."""
    return F.least(F.lit(bands - 1), F.floor(p * bands).cast("int"))


def outcome_index(home: Column, away: Column) -> Column:
    """0 home win, 1 draw, 2 away win."""
    return F.when(home > away, 0).when(home == away, 1).otherwise(2)


def multiclass_brier(probs: list[Column], actual: Column) -> Column:
    return sum(
        (squared_error(p, (actual == i).cast("double")) for i, p in enumerate(probs)), F.lit(0.0)
    )


def multiclass_log_loss(probs: list[Column], actual: Column) -> Column:
    return -F.log(F.greatest(F.lit(LOG_EPS), F.element_at(F.array(*probs), actual + 1)))


def implied_probabilities(odds: list[Column]) -> list[Column]:
    """Bookmaker odds with the margin removed proportionally."""
    inverse = [1.0 / o for o in odds]
    total = sum(inverse[1:], inverse[0])
    return [i / total for i in inverse]


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two numeric arrays, 0 when either has no length."""
    def dot(a, b):
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
            F.lit(0.0), lambda acc, x: acc + x,
        )
    return F.coalesce(
        F.try_divide(dot(u, v), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))), F.lit(0.0)
    )


def evidence_weight(actions: Column, half_at: int) -> Column:
    """a / (a + half_at): 0 without evidence, 0.5 at ``half_at``."""
    a = F.greatest(F.lit(0), actions).cast("double")
    return a / (a + half_at)


def geometric_confidence(
    n_events: Column, quality, agreement, instability: Column, cases,
    n_ref: float = 40.0, cases_ref: float = 50.0,
) -> Column:
    """Fifth root of the product of five factors clamped to [0, 1]."""
    def unit(c):
        return clip(c if isinstance(c, Column) else F.lit(float(c)), 0.0, 1.0)
    cases = cases if isinstance(cases, Column) else F.lit(float(cases))
    product = (
        unit(n_events / n_ref) * unit(quality) * unit(agreement)
        * unit(1.0 - instability) * unit(cases / cases_ref)
    )
    return F.pow(product, F.lit(0.2))
