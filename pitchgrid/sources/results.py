"""Result files: statistics CSV and community JSON, unified as provider records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.clock import day_month_year, iso_date

# fixed values of the CSV format: file column -> record field
CSV_FIELDS = {
    "FTHG": "home_goals", "FTAG": "away_goals", "HTHG": "ht_home", "HTAG": "ht_away", "HC": "corners_home", "AC": "corners_away",
    "HY": "yellows_home", "AY": "yellows_away", "HR": "reds_home", "AR": "reds_away",
}
COMMUNITY_SCHEMA = (
    "matches ARRAY<STRUCT<date: STRING, team1: STRING, team2: STRING, score: STRUCT<ft: ARRAY<INT>, ht: ARRAY<INT>>>>, "
    "rounds ARRAY<STRUCT<matches: ARRAY<STRUCT<date: STRING, team1: STRING, team2: STRING, score: STRUCT<ft: ARRAY<INT>, ht: ARRAY<INT>>>>>>")


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, Latin-1; types are cast by :func:`results_records`."""
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").csv(path)


def results_records(rows: DataFrame, source: str) -> DataFrame:
    """Typed records; a row with any unreadable value is skipped."""
    out = rows.select(
        F.lit(source).alias("source"), day_month_year(F.col("Date")).alias("date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"),
        *[F.expr(f"try_cast(trim({c}) AS INT)").alias(f) for c, f in CSV_FIELDS.items()],
        *[c for c in rows.columns if c not in (*CSV_FIELDS, "Date", "HomeTeam", "AwayTeam")])
    needed = ["date", "home", "away", *CSV_FIELDS.values()]
    return out.dropna(subset=needed)


def read_community_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMUNITY_SCHEMA).option("multiLine", True).json(path)


def community_records(docs: DataFrame, source: str, keep: list[str] = []) -> DataFrame:
    """Results listed flat or by round; half-time may be missing, full time may not."""
    listed = F.when(F.size("matches") > 0, F.col("matches")).otherwise(F.flatten(F.transform("rounds", lambda r: r.matches)))
    m = docs.select(*keep, F.explode(listed).alias("m"))
    ft, ht = F.col("m.score.ft"), F.col("m.score.ht")
    return m.where(F.size(ft) > 0).select(
        *keep, F.lit(source).alias("source"), iso_date(F.col("m.date")).alias("date"), F.col("m.team1").alias("home"), F.col("m.team2").alias("away"),
        F.get(ft, F.lit(0)).alias("home_goals"), F.get(ft, F.lit(1)).alias("away_goals"),
        F.get(ht, F.lit(0)).alias("ht_home"), F.get(ht, F.lit(1)).alias("ht_away"))


def all_providers(*records: DataFrame) -> DataFrame:
    """One table of all providers; fields a provider lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)


class ProviderRegistry:
    """Providers by name: a trust prior and a reader returning the record schema."""

    def __init__(self) -> None:
        self._providers: dict = {}

    def add(self, name: str, prior: float, reader) -> None:
        self._providers[name] = (prior, reader)

    def priors(self) -> dict[str, float]:
        return {n: p for n, (p, _) in self._providers.items()}

    def records(self) -> DataFrame:
        return all_providers(*[reader() for _, (_, reader) in sorted(self._providers.items())])
