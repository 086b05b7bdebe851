"""Connected components by contraction, with reliable cuts between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it is linked with, itself included) for all nodes of ``edges`` (a, b).

    Each round maps every node to its smallest neighbour and contracts the edges; the smallest node of a component maps
    to itself and stays to the end. At least half of the nodes vanish in a round, so the rounds grow with the logarithm
    of the largest component. Minima are partial aggregates and the joins are plain equi-joins, so a node with very many
    neighbours is spread like any skewed key.
    """
    edges = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().select("node", F.col("node").alias("component")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        edges = stored(
            edges.join(low.select("a", F.col("low").alias("low_a")), "a").join(low.select(F.col("a").alias("b"), F.col("low").alias("low_b")), "b")
            .filter("low_a <> low_b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b")).distinct(), "edges")
        labels = stored(
            labels.join(low.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
    return labels
