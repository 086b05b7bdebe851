"""Open event and tracking formats: text in, valid rows and explained rejects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.text import content_id, player_id
from pitchgrid.settings import OPEN_FORMAT_TYPES, SIDES

REQUIRED = ("match_id", "date", "home_team", "away_team", "minute", "team", "type")
OPTIONAL = ("x", "y", "player_id")
MAX_MINUTE = 150.0


def read_text_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or JSON lines / arrays, every field as text."""
    columns = [*REQUIRED, *OPTIONAL]
    if path.endswith(".json"):
        rows = spark.read.schema(", ".join(f"{c} STRING" for c in columns)).option("multiLine", True).json(path)
    else:
        rows = spark.read.option("header", True).csv(path)
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows


def validate(rows: DataFrame) -> DataFrame:
    """Add typed columns and ``reject_reason`` (null = valid): the first failing rule.

    Emptiness is a null test, so minute 0 and x 0 are accepted.
    """
    clean = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in (*REQUIRED, *OPTIONAL)}
    missing = F.array_join(F.array_compact(F.array(*[F.when(clean[c].isNull(), F.lit(c)) for c in REQUIRED])), ",")
    number = lambda c: F.expr(f"try_cast(trim(cast({c} AS STRING)) AS DOUBLE)")
    minute, x, y = number("minute"), number("x"), number("y")
    def off_pitch(name, value):
        return F.when(clean[name].isNotNull() & (value.isNull() | F.isnan(value)), F.concat(F.lit(f"{name} is not a number"))).when(
            clean[name].isNotNull() & ~value.between(0, 100), F.lit(f"{name} outside 0-100"))
    reason = F.coalesce(
        F.when(missing != "", F.concat(F.lit("missing "), missing)),
        F.when(~clean["type"].isin(*OPEN_FORMAT_TYPES), F.concat(F.lit("unknown type "), clean["type"])),
        F.when(~F.upper(clean["team"]).isin(*SIDES), F.concat(F.lit("unknown side "), clean["team"])),
        F.when(minute.isNull(), F.lit("minute is not a number")),
        F.when(F.isnan(minute) | ~minute.between(0, MAX_MINUTE), F.lit("minute outside 0-150")),
        off_pitch("x", x), off_pitch("y", y))
    rest = [c for c in rows.columns if c not in (*REQUIRED, *OPTIONAL)]
    return rows.select(
        *rest, clean["match_id"].alias("match_id"), clean["date"].alias("date"), clean["home_team"].alias("home_team"),
        clean["away_team"].alias("away_team"), minute.alias("minute"), F.upper(clean["team"]).alias("team"), clean["type"].alias("type"),
        x.alias("x"), y.alias("y"), clean["player_id"].alias("player_id"), reason.alias("reject_reason"))


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.where("reject_reason IS NULL").drop("reject_reason")


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where("reject_reason IS NOT NULL")


def ingest(valid: DataFrame, existing: DataFrame, *, replace: bool = False) -> DataFrame:
    """Match headers to write: new ones, or all when replacing; the score comes from goals."""
    side = lambda s: F.count_if((F.col("type") == "goal") & (F.col("team") == s))
    heads = valid.groupBy("match_id").agg(
        F.min("date").alias("match_date"), F.min("home_team").alias("home_team"), F.min("away_team").alias("away_team"),
        side("HOME").alias("home_goals_final"), side("AWAY").alias("away_goals_final"), F.count("*").alias("n_events"))
    return heads if replace else heads.join(existing.select("match_id"), "match_id", "left_anti")


# tracking ------------------------------------------------------------------ #
def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    schema = "t STRING, player_id STRING, team STRING, x STRING, y STRING, player STRING"
    if path.endswith(".json"):
        doc = spark.read.schema(f"frames ARRAY<STRUCT<{schema.replace(' STRING', ': STRING')}>>, {schema}").option("multiLine", True).json(path)
        one = F.array(F.struct(*[F.col(c.split()[0]) for c in schema.split(", ")]))
        return doc.select(F.explode(F.coalesce("frames", one)).alias("f")).select("f.*")
    return spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path)


def frames(rows: DataFrame, keep: list[str] = []) -> DataFrame:
    """Typed frames; rows missing a required field are skipped, not guessed."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)").alias(c)
    return rows.select(*keep, number("t"), "player_id", "team", number("x"), number("y"), F.nullif(F.col("player"), F.lit("")).alias("player")).dropna(
        subset=["t", "player_id", "x", "y"])


def position_records(frame_rows: DataFrame, match_id: Column, source: str) -> DataFrame:
    """Frames as canonical observed records with provider-independent player ids."""
    out = frame_rows.select(
        F.lit("position").alias("kind"), F.lit("observed").alias("layer"), match_id.alias("match_id"),
        player_id(F.coalesce("player", "player_id")).alias("player_id"), "team", F.col("t").alias("second"),
        F.to_json(F.struct("x", "y", "t")).alias("value"), F.lit(source).alias("source"), F.lit("stage:canonical").alias("transformation"))
    return out.withColumn("id", content_id(*[F.col(c) for c in ("kind", "match_id", "player_id", "second", "value", "source")]))
