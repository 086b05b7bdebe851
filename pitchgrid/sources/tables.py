"""Table sinks: keyed replacement, incremental append, audited refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``; rerunning gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_keys(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows of untouched keys plus all incoming rows (write to a new snapshot)."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming.select(*stored.columns))


def missing_only(candidates: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been materialised yet."""
    return candidates.join(stored.select(*keys).distinct(), keys, "left_anti")


def refresh_audit(landed: DataFrame, existing: DataFrame, issues: DataFrame, pair: list[str]) -> DataFrame:
    """One audit row per competition/season of an incremental refresh."""
    new = landed.join(existing.select("match_id").withColumn("known", F.lit(True)), "match_id", "left")
    bad = issues.groupBy("match_id").agg(F.count("*").alias("n_issues"))
    new = new.join(bad, "match_id", "left")
    added = F.col("known").isNull()
    return new.groupBy(*pair).agg(
        F.count_if(added).alias("matches_added"), F.count_if(~added).alias("matches_skipped"),
        F.coalesce(F.sum(F.when(added, F.col("n_issues"))), F.lit(0)).alias("issues"),
        (F.count_if(added & F.col("n_issues").isNotNull()) == 0).alias("quality_ok"))


def scored_pairs(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions beside their resolved outcomes."""
    return predictions.join(outcomes, "prediction_id").select("prediction_id", "prob", "happened")
