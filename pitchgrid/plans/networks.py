"""Passing networks per (match, side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.scoring import ratio
from pitchgrid.operators.ordered import top_k

SCOPE = ["match_id", "side"]


def edges(passes: DataFrame) -> DataFrame:
    """Successful passes as weighted directed edges with chance counts."""
    return passes.where("success AND dst IS NOT NULL").groupBy(*SCOPE, "src", "dst").agg(
        F.count("*").alias("passes"), F.count_if("chance").alias("chances"))


def strengths(edge_table: DataFrame) -> DataFrame:
    """Passes touching each node, from both ends."""
    ends = edge_table.select(*SCOPE, F.explode(F.array("src", "dst")).alias("node"), "passes")
    return ends.groupBy(*SCOPE, "node").agg(F.sum("passes").alias("strength"))


def critical_nodes(edge_table: DataFrame, k: int) -> DataFrame:
    return top_k(strengths(edge_table), SCOPE, [F.col("strength").desc(), F.col("node")], k)


def metrics(edge_table: DataFrame) -> DataFrame:
    """Robustness (1 - Herfindahl), dependence on the busiest node, density."""
    s = F.col("strength").cast("double")
    by_node = strengths(edge_table).groupBy(*SCOPE).agg(
        F.sum(s).alias("total"), F.sum(s * s).alias("squares"), F.max(s).alias("top"), F.count("*").alias("n_nodes"))
    size = edge_table.groupBy(*SCOPE).agg(F.count("*").alias("n_edges"))
    k = F.col("n_nodes")
    return by_node.join(size, SCOPE).select(
        *SCOPE, "n_nodes", "n_edges",
        F.when(F.col("total") > 0, 1.0 - F.col("squares") / (F.col("total") * F.col("total"))).otherwise(0.0).alias("robustness"),
        ratio(F.col("top"), F.col("total")).alias("dependence"),
        F.when(k < 2, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("n_edges"), k * (k - 1)))).alias("fluidity"))


def payload(edge_table: DataFrame, nodes: int = 11, limit: int = 30) -> DataFrame:
    """Strongest edges among the most involved nodes of each network."""
    central = critical_nodes(edge_table, nodes).select(*SCOPE, "node")
    kept = edge_table.join(central.withColumnRenamed("node", "src"), [*SCOPE, "src"], "left_semi").join(
        central.withColumnRenamed("node", "dst"), [*SCOPE, "dst"], "left_semi")
    return top_k(kept, SCOPE, [F.col("passes").desc(), F.col("src"), F.col("dst")], limit)
