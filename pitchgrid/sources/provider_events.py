"""Event-provider JSON: raw events to normalised events, ball stream, passes, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.clock import rescale_x, rescale_y
from pitchgrid.operators.skew import salted_join

# fixed values of the provider format
ON_TARGET = ("Saved", "Saved to Post")
RED = ("Red Card", "Second Yellow")
SEGMENTS = ("Pass", "Carry", "Shot")
POINTS = ("Ball Receipt*", "Ball Recovery", "Dribble", "Clearance", "Interception", "Block", "Duel",
          "Goal Keeper", "Foul Committed", "Miscontrol")
SHOOTOUT = 5

_PERSON = "STRUCT<id: BIGINT, name: STRING>"
_NAMED = "STRUCT<name: STRING>"
EVENT_SCHEMA = (
    f"match_id STRING, event_no BIGINT, minute INT, second INT, period INT, duration DOUBLE, type {_NAMED}, team {_NAMED}, "
    f"player {_PERSON}, position {_NAMED}, location ARRAY<DOUBLE>, "
    f"shot STRUCT<outcome: {_NAMED}, statsbomb_xg: DOUBLE, end_location: ARRAY<DOUBLE>>, "
    f"pass STRUCT<type: {_NAMED}, outcome: {_NAMED}, end_location: ARRAY<DOUBLE>, recipient: {_PERSON}, shot_assist: BOOLEAN, goal_assist: BOOLEAN>, "
    f"dribble STRUCT<outcome: {_NAMED}>, carry STRUCT<end_location: ARRAY<DOUBLE>>, "
    f"foul_committed STRUCT<card: {_NAMED}>, bad_behaviour STRUCT<card: {_NAMED}>, "
    f"substitution STRUCT<replacement: {_PERSON}>, tactics STRUCT<lineup: ARRAY<STRUCT<player: {_PERSON}>>>")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed event files (one JSON array per match, named events_<match>.json)."""
    raw = spark.read.schema(EVENT_SCHEMA).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"events_(.+)\.json$", 1)
    return raw.withColumn("match_id", F.coalesce("match_id", name))


def parse_raw(lines: DataFrame, column: str = "json") -> DataFrame:
    return lines.select(F.from_json(F.col(column), EVENT_SCHEMA).alias("r")).select("r.*")


def clock() -> Column:
    return F.coalesce(F.col("minute"), F.lit(0)).cast("double") + F.coalesce(F.col("second"), F.lit(0)) / 60.0


def with_side(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """Resolve HOME/AWAY by team name; events of any other team are dropped."""
    names = matches.select("match_id", "home_team", "away_team")
    team = F.col("team.name")
    side = F.when(team == F.col("home_team"), "HOME").when(team == F.col("away_team"), "AWAY")
    return salted_join(raw, names, ["match_id"], ["event_no"]).withColumn("side", side).where("side IS NOT NULL")


def _in_play() -> Column:
    return ~F.col("period").eqNullSafe(F.lit(SHOOTOUT))


def normalize(raw: DataFrame, matches: DataFrame, *, own_goals: bool = True) -> DataFrame:
    """Zero to two normalised events per raw event; a goal is also a shot on target.

    Provider own goals become goals of the side they count for unless switched off.
    """
    kind, shot, foul, bad = F.col("type.name"), F.col("shot.outcome.name"), F.col("foul_committed.card.name"), F.col("bad_behaviour.card.name")
    is_shot, is_foul, is_bad = kind == "Shot", kind == "Foul Committed", kind == "Bad Behaviour"
    on_target = shot.isin("Goal", *ON_TARGET)
    card = F.when(is_foul, foul).when(is_bad, bad)
    types = F.array_compact(F.array(
        F.when(is_shot & F.coalesce(on_target, F.lit(False)), "shot_on_target").when(is_shot, "shot"),
        F.when(is_shot & (shot == "Goal"), "goal"),
        F.when(F.lit(own_goals) & (kind == "Own Goal For"), "goal"),
        F.when((kind == "Pass") & (F.col("pass.type.name") == "Corner"), "corner"),
        F.when(is_foul, "foul"),
        F.when(card.isin(*RED), "red_card").when(card == "Yellow Card", "yellow_card")))
    rows = with_side(raw, matches).where(_in_play())
    loc = F.col("location")
    return rows.select(
        "match_id", "event_no", clock().alias("minute"), F.col("side").alias("team"), F.explode(types).alias("type"),
        F.col("player.id").cast("string").alias("player_id"), rescale_x(F.get(loc, F.lit(0))).alias("x"),
        rescale_y(F.get(loc, F.lit(1))).alias("y"), F.when(is_shot, F.col("shot.statsbomb_xg")).alias("xg"))


def ball_stream(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """Dense timed on-ball stream; segment columns are null for point actions."""
    kind = F.col("type.name")
    home = matches.select("match_id", "home_team")
    rows = salted_join(raw, home, ["match_id"], ["event_no"]).where(kind.isin(*SEGMENTS, *POINTS) & (F.size("location") > 0))
    end = F.when(kind == "Pass", F.col("pass.end_location")).when(kind == "Carry", F.col("carry.end_location")).when(kind == "Shot", F.col("shot.end_location"))
    loc = F.col("location")
    return rows.select(
        "match_id", "event_no", (F.coalesce("minute", F.lit(0)) * 60.0 + F.coalesce("second", F.lit(0))).alias("t"), kind.alias("type"),
        F.when(F.col("team.name") == F.col("home_team"), "HOME").otherwise("AWAY").alias("team"),
        F.col("player.name").alias("player"), F.col("player.id").cast("string").alias("player_id"),
        rescale_x(F.get(loc, F.lit(0))).alias("x"), rescale_y(F.get(loc, F.lit(1))).alias("y"),
        rescale_x(F.get(end, F.lit(0))).alias("x2"), rescale_y(F.get(end, F.lit(1))).alias("y2"),
        F.when(kind.isin(*SEGMENTS), F.coalesce("duration", F.lit(0.0))).alias("dur"),
        F.when(kind == "Shot", F.col("shot.outcome.name")).alias("outcome"))


def pass_records(raw: DataFrame) -> DataFrame:
    """Passes of all teams: a completed pass has a recipient and no outcome."""
    p = F.col("pass")
    return raw.where((F.col("type.name") == "Pass") & F.col("player.id").isNotNull()).select(
        "match_id", "event_no", F.col("team.name").alias("team"), F.col("player.id").cast("string").alias("src"),
        p.recipient.id.cast("string").alias("dst"), (p.outcome.isNull() & p.recipient.id.isNotNull()).alias("success"),
        (F.coalesce(p.shot_assist, F.lit(False)) | F.coalesce(p.goal_assist, F.lit(False))).alias("chance"))


def match_headers(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Match rows with duration = floor(last normalised minute) + 1."""
    last = events.groupBy("match_id").agg(F.max("minute").alias("last"))
    return matches.join(last, "match_id", "left").withColumn(
        "duration", (F.floor(F.coalesce("last", F.lit(90.0))) + 1).cast("int")).drop("last")


def match_facts(raw: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """Half-time score incl. own goals, corners and cards per match as one provider record."""
    r = with_side(raw, matches)
    kind = F.col("type.name")
    scored = ((kind == "Shot") & (F.col("shot.outcome.name") == "Goal")) | (kind == "Own Goal For")
    half = r.where((F.col("period") == 1) & scored).groupBy("match_id").agg(
        *[F.count_if(F.col("side") == s.upper()).alias(f"ht_{s}") for s in ("home", "away")])
    counts = normalize(raw, matches).groupBy("match_id").agg(*[
        F.count_if((F.col("type") == t) & (F.col("team") == s.upper())).alias(f"{n}_{s}")
        for n, t in (("corners", "corner"), ("yellows", "yellow_card"), ("reds", "red_card")) for s in ("home", "away")])
    return matches.join(counts, "match_id", "left").join(half, "match_id", "left").fillna(
        0, [f"{n}_{s}" for n in ("ht", "corners", "yellows", "reds") for s in ("home", "away")]).withColumn("source", F.lit(source))


def match_records(raw: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """The provider records of raw events, as the other providers give them: date, teams, final and half-time score, corners and cards.

    ``matches`` has the headers with match_date and the final scores.
    """
    heads = matches.select("match_id", "home_team", "away_team", F.col("match_date").alias("date"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
                           F.col("home_goals_final").alias("home_goals"), F.col("away_goals_final").alias("away_goals"))
    return match_facts(raw, heads, source).drop("match_id", "home_team", "away_team")


def player_actions(raw: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """Action rows for the player counters."""
    p = F.col("pass")
    rows = with_side(raw, matches).where(_in_play() & F.col("player.id").isNotNull())
    return rows.select(
        F.col("player.id").cast("string").alias("player_id"), F.col("player.name").alias("name"), F.col("team.name").alias("team"),
        F.col("position.name").alias("position"), "match_id", F.lit(source).alias("source"), F.col("type.name").alias("action"),
        p.outcome.isNull().alias("completed"), (F.get(p.end_location, F.lit(0)) - F.get(F.col("location"), F.lit(0))).alias("advance"),
        F.coalesce(p.shot_assist, F.lit(False)).alias("shot_assist"), F.coalesce(p.goal_assist, F.lit(False)).alias("goal_assist"),
        (F.col("shot.outcome.name") == "Goal").alias("scored"), (F.col("dribble.outcome.name") == "Complete").alias("won"))


def lineups_and_changes(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Starters, substitutions / sendings-off, goals and match ends for on/off minutes."""
    kind = F.col("type.name")
    base = raw.withColumn("team", F.col("team.name")).withColumn("clock", clock())
    starters = base.where(kind == "Starting XI").select(
        "match_id", "team", F.explode("tactics.lineup").alias("slot")).select("match_id", "team", F.col("slot.player.id").cast("string").alias("player_id"))
    card = F.when(kind == "Foul Committed", F.col("foul_committed.card.name")).when(kind == "Bad Behaviour", F.col("bad_behaviour.card.name"))
    changes = base.where((kind == "Substitution") | card.isin(*RED)).select(
        "match_id", "team", F.col("event_no").alias("seq"), F.col("clock").alias("minute"), F.col("player.id").cast("string").alias("off_id"),
        F.when(kind == "Substitution", F.col("substitution.replacement.id").cast("string")).alias("on_id"))
    goals = base.where((kind == "Shot") & (F.col("shot.outcome.name") == "Goal")).select("match_id", "team", F.col("clock").alias("minute"))
    ends = base.groupBy("match_id").agg(F.max("clock").alias("match_end"))
    return starters, changes, goals, ends
