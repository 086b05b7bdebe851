"""Landed entity search results: biographical facts by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.clock import iso_date
from pitchgrid.operators.ordered import first_by

FOOTBALLER = "Q937857"   # fixed value: the occupation a hit must have


def with_labels(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Readable label of an id column; an id without a label stays an id."""
    lookup = labels.select(F.col("qid").alias(column), F.col("label").alias("__label"))
    return rows.join(lookup, column, "left").withColumn(name, F.coalesce("__label", column)).drop("__label")


def bios(hits: DataFrame, entities: DataFrame, labels: DataFrame, occupation: str = FOOTBALLER) -> DataFrame:
    """Per name the best-ranked hit with the required occupation; no such hit, no row.

    ``hits(name, rank, qid)``; ``entities(qid, occupations array<string>, birth, height,
    position, country)``; heights under 3 are metres.
    """
    fits = entities.where(F.array_contains("occupations", occupation))
    best = first_by(hits.join(fits, "qid"), ["name"], [F.col("rank"), F.col("qid")])
    height = F.expr("try_cast(height AS DOUBLE)")
    out = best.select(
        "name", "qid", iso_date(F.ltrim(F.col("birth"), F.lit("+"))).alias("birth_date"),
        F.bround(F.when(height < 3, height * 100).otherwise(height), 0).cast("int").alias("height_cm"), "position", "country")
    return with_labels(with_labels(out, labels, "country", "citizenship"), labels, "position", "position_name").drop("country", "position")
