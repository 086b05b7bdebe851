"""Joining very large event tables to per-match facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str], how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Equi-join where one key may hold a large part of ``big``.

    Rows of ``big`` are spread over ``salts`` sub-keys by a hash of ``salt_by`` (stable
    under retries) and ``small`` (few rows per key) is repeated for each of them, so a hot
    key reaches that many tasks. Later aggregations on the same keys get their own,
    map-side-combined shuffle instead of inheriting a skewed one.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("only joins that keep rows of the big side")
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    right = small.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
