"""Match-detail JSON with goals, bookings and substitutions; also polled live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEAM = "STRUCT<id: BIGINT, name: STRING>"
DETAIL_SCHEMA = (
    f"id BIGINT, utcDate STRING, status STRING, minute INT, homeTeam {_TEAM}, awayTeam {_TEAM}, "
    "score STRUCT<winner: STRING, fullTime: STRUCT<home: INT, away: INT>, halfTime: STRUCT<home: INT, away: INT>>, "
    f"goals ARRAY<STRUCT<minute: INT, injuryTime: INT, type: STRING, team: {_TEAM}, scorer: {_TEAM}>>, "
    f"bookings ARRAY<STRUCT<minute: INT, team: {_TEAM}, player: {_TEAM}, card: STRING>>, "
    f"substitutions ARRAY<STRUCT<minute: INT, team: {_TEAM}, playerOut: {_TEAM}, playerIn: {_TEAM}>>")
# fixed values of the provider format
CARDS = {"YELLOW": "yellow_card", "RED": "red_card", "YELLOW_RED": "red_card"}


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETAIL_SCHEMA).option("multiLine", True).json(path)


def parse_details(lines: DataFrame, column: str = "json") -> DataFrame:
    return lines.select("*", F.from_json(F.col(column), DETAIL_SCHEMA).alias("__r")).select(
        *[c for c in lines.columns if c != column], "__r.*")


def _side(team: Column) -> Column:
    home, away = F.col("homeTeam"), F.col("awayTeam")
    same = lambda a, b, f: a.getField(f) == b.getField(f)
    return F.when(same(team, home, "id"), "HOME").when(same(team, away, "id"), "AWAY").when(
        same(team, home, "name"), "HOME").when(same(team, away, "name"), "AWAY")


def _rows(details: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return details.select(*keep, F.col("id").cast("string").alias("match_id"), "homeTeam", "awayTeam", F.explode(column).alias("e"))


def events_from_details(details: DataFrame, keep: list[str] = []) -> DataFrame:
    """Goals, cards and substitutions; rows without side or minute are dropped."""
    def shape(rows, kind, player):
        return rows.select(*keep, "match_id", F.col("e.minute").cast("double").alias("minute"), _side(F.col("e.team")).alias("team"),
                           kind.alias("type"), player.cast("string").alias("player_id"))
    card = F.try_element_at(F.create_map(*[F.lit(x) for kv in CARDS.items() for x in kv]), F.col("e.card"))
    out = shape(_rows(details, "goals", keep), F.lit("goal"), F.col("e.scorer.id")).unionByName(
        shape(_rows(details, "bookings", keep), card, F.col("e.player.id"))).unionByName(
        shape(_rows(details, "substitutions", keep), F.lit("substitution"), F.col("e.playerIn.id")))
    return out.where("minute IS NOT NULL AND team IS NOT NULL AND type IS NOT NULL")


def live_clock(details: DataFrame, keep: list[str] = []) -> DataFrame:
    """Provider minute when given, else the last event's, else 0."""
    last = lambda c: F.coalesce(F.array_max(F.transform(c, lambda e: e.minute)), F.lit(0))
    fallback = F.greatest(last("goals"), last("bookings"), last("substitutions"))
    return details.select(*keep, F.col("id").cast("string").alias("match_id"), F.coalesce("minute", fallback).cast("double").alias("minute"))
