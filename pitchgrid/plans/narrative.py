"""Opinions as hypotheses, verdicts against data, credibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.ordered import running_sums

GOOD = ("Confirmed", "Partially confirmed")


def verdict(direction: Column, z: Column) -> Column:
    """Label of a directional hypothesis given the standardised deviation."""
    size = F.abs(z)
    want = F.when(direction == "better", 1.0).when(direction == "worse", -1.0).otherwise(0.0)
    agrees = F.signum(z) == want
    neutral = F.when(size <= 0.5, "Confirmed").when(size > 1.5, "Strongly contradicted").otherwise("Not confirmed")
    directed = (
        F.when(agrees & (size > 1.5), "Confirmed").when(agrees & (size > 0.5), "Partially confirmed")
        .when(~agrees & (size > 1.5), "Strongly contradicted").otherwise("Not confirmed"))
    return F.when(direction == "same", neutral).otherwise(directed)


def verify(direction: Column, value: Column, mean: Column, std: Column) -> Column:
    """Verdict; anything that cannot be standardised is not confirmed."""
    def odd(c):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    z = F.try_divide(value - mean, std)
    return F.when(odd(value) | odd(mean) | odd(std) | (std <= 0), "Not confirmed").otherwise(verdict(direction, z))


def collective_state(emotion: Column, reality: Column, threshold: float = 40.0) -> list[Column]:
    gap = F.abs(emotion - reality)
    return [gap.alias("divergence"), (gap > threshold).alias("overreaction")]


def divergence(perception: Column, reality: Column) -> Column:
    return F.abs(reality - perception)


def credibility(labelled: DataFrame, key: str) -> DataFrame:
    """Final hit rate per source (or narrative pattern)."""
    hit = F.col("label").isin(*GOOD)
    return labelled.groupBy(key).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"),
                                     F.avg(hit.cast("double")).alias("weight"))


def running_credibility(labelled: DataFrame, key: str, order: str, bucket: Column) -> DataFrame:
    """Hit rate after each verdict, in arrival order."""
    run = running_sums(labelled, [key], bucket, [F.col(order)], {
        "hits": F.col("label").isin(*GOOD).cast("bigint"), "total": F.lit(1)})
    return run.withColumn("weight", F.col("hits") / F.col("total"))


def coach_profile(rows: DataFrame, metric: Column, contexts: tuple = ("winning", "losing", "drawing")) -> DataFrame:
    """One metric per (coach, score context), spread over columns."""
    c = F.col("context")
    return rows.groupBy("coach").agg(*[F.avg(F.when(c == x, metric)).alias(x) for x in contexts])


def philosophy(winning: Column, losing: Column) -> Column:
    return F.when((losing == "press") & (winning == "hold"), "OFFENSIVE").when(
        (losing == "hold") & (winning == "retreat"), "PRAGMATIC").otherwise("BALANCED")


def divergence_index(rows: DataFrame, keys: list[str], perception: Column | None = None, reality: Column | None = None) -> DataFrame:
    """Distance between two injected aggregate scorers per target; both default to 0."""
    zero = F.max(F.lit(0.0))
    scored = rows.groupBy(*keys).agg((perception if perception is not None else zero).alias("perception"),
                                     (reality if reality is not None else zero).alias("reality"))
    return scored.withColumn("divergence", divergence(F.col("perception"), F.col("reality")))
