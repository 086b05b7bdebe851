"""Player counters, profiles, behaviour, on/off influence, scouting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.clock import age_factor, age_on
from pitchgrid.functions.scoring import clip, evidence_weight, ratio, unit_scale
from pitchgrid.operators.ordered import first_by, mid_rank, numbered, running_sums
from pitchgrid.operators.skew import salted_join
from pitchgrid.shared import cut
from pitchgrid.settings import (
    AVATAR_RANGES, COUNTERS, MIN_ACTIONS, MIN_DRIBBLES, PROGRESSIVE_MIN, REF_DISCIPLINE,
    REF_TURNOVER, VECTOR_RANGES,
)

SEASON = ["player_id", "competition", "season"]


def counters(actions: DataFrame) -> DataFrame:
    """Additive counters per (player, competition, season).

    ``actions`` has action, completed, advance, shot_assist, goal_assist, scored, won and
    match_id, source, name, team, position.
    """
    kind = F.col("action")
    passed, done = kind == "Pass", F.col("completed")
    expr = {
        "actions": kind.isin("Pass", "Shot", "Dribble", "Carry"),
        "passes": passed, "passes_completed": passed & done,
        "progressive": passed & done & (F.col("advance") >= PROGRESSIVE_MIN),
        "key_passes": passed & F.col("shot_assist"), "assists": passed & F.col("goal_assist"),
        "shots": kind == "Shot", "goals": (kind == "Shot") & F.col("scored"),
        "dribbles": kind == "Dribble", "dribbles_completed": (kind == "Dribble") & F.col("won"),
        "turnovers": kind.isin("Dispossessed", "Miscontrol"),
    }
    return actions.groupBy(*SEASON).agg(
        *[F.count_if(expr[c]).alias(c) for c in COUNTERS],
        F.count_distinct("match_id").alias("matches"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        latest(actions).alias("latest")).select("*", "latest.*").drop("latest")


def latest(actions: DataFrame) -> Column:
    """Name, team and position of one row: the last by date, match and event number, as far as the table has them."""
    who = ("name", "team", "position")
    order = [c for c in ("date", "match_id", "event_id", *who) if c in actions.columns]
    return F.max_by(F.struct(*who), F.struct(*order))


def roll_up(season_counters: DataFrame) -> DataFrame:
    """Career counters: exact sums, union of sources, latest name and team."""
    latest_season = F.struct("season", "competition", "name", "team", "position")
    return season_counters.groupBy("player_id").agg(
        *[F.sum(c).alias(c) for c in (*COUNTERS, "matches")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.max_by(F.struct("name", "team", "position"), latest_season).alias("l")).select("*", "l.*").drop("l")


def label(actions: Column, shots: Column, assists: Column, dribbles: Column, shot_share: Column, key_rate: Column,
          turnover: Column, dribble_success: Column, accuracy: Column) -> Column:
    """Descriptive label; the first matching rule wins."""
    return (
        F.when(actions < MIN_ACTIONS, "insufficient_data")
        .when((shot_share >= 0.05) & (shots >= 6), "finisher")
        .when((key_rate >= 0.035) | (assists >= 3), "creator")
        .when((turnover >= 0.04) & (dribbles >= 10) & (dribble_success < 0.6), "impulsive")
        .when((accuracy >= 0.85) & (shot_share < 0.02), "conservative")
        .otherwise("balanced"))


def style_label(shot_frequency: Column, time_to_shot: Column, progressive: Column, assist_frequency: Column,
                turnover: Column, hard_dribbles: Column, risk: Column, lateral: Column) -> Column:
    """Label from observed style shares; missing inputs never trigger a rule."""
    return (
        F.when((shot_frequency > 0.4) & (time_to_shot < 2), "finisher")
        .when((progressive > 0.15) & (assist_frequency > 0.3), "creator")
        .when((turnover > 0.2) & (hard_dribbles > 0.3), "impulsive")
        .when((risk < 0.1) & (lateral > 0.6), "conservative")
        .otherwise("balanced"))


def profiles(counted: DataFrame) -> DataFrame:
    """Ratios, label, evidence confidence and normalised style dimensions."""
    c = F.col
    out = counted.select(
        "*", ratio(c("passes_completed"), c("passes")).alias("pass_accuracy"),
        ratio(c("progressive"), c("passes_completed")).alias("progressive_pass_share"),
        ratio(c("key_passes"), c("passes")).alias("key_pass_rate"), ratio(c("shots"), c("actions")).alias("shot_share"),
        ratio(c("turnovers"), c("actions")).alias("turnover_rate"),
        ratio(c("dribbles_completed"), c("dribbles")).alias("dribble_success"),
        ratio(c("goals"), c("actions")).alias("goal_rate"), ratio(c("assists"), c("actions")).alias("assist_rate"),
        F.round(evidence_weight(c("actions"), MIN_ACTIONS), 3).alias("confidence"))
    out = out.withColumn("label", label(
        c("actions"), c("shots"), c("assists"), c("dribbles"), c("shot_share"), c("key_pass_rate"),
        c("turnover_rate"), c("dribble_success"), c("pass_accuracy")))
    source = {"pass_accuracy": "pass_accuracy", "progressive_pass": "progressive_pass_share",
              "shot_frequency": "shot_share", "assist_frequency": "key_pass_rate", "turnover_rate": "turnover_rate"}
    return out.select("*", *[unit_scale(c(source[n]), lo, hi).alias(f"style_{n}") for n, (lo, hi) in AVATAR_RANGES.items()])


def style_vector() -> Column:
    return F.array(*[unit_scale(F.col(n), lo, hi) for n, lo, hi in VECTOR_RANGES])


def decision_shares(receptions: DataFrame) -> DataFrame:
    """Next-action distribution per (player, zone); zero rows where none is known."""
    known = ("shot", "pass", "dribble", "drop")
    counts = receptions.groupBy("player_id", "zone").agg(
        *[F.count_if(F.col("next_action") == a).alias(a) for a in known])
    total = sum((F.col(a) for a in known[1:]), F.col(known[0]))
    return counts.select("player_id", "zone", *[ratio(F.col(a), total).alias(a) for a in known])


# --------------------------------------------------------------------------- #
# On/off influence
# --------------------------------------------------------------------------- #
def on_off(lineups: DataFrame, changes: DataFrame, goals: DataFrame, ends: DataFrame) -> DataFrame:
    """Minutes and team goals with each player on the pitch, per match.

    ``lineups(match_id, team, player_id)``, ``changes(match_id, team, seq, minute,
    off_id, on_id)`` (red cards have no on_id), ``goals(match_id, team, minute)``,
    ``ends(match_id, match_end)``. Goals inside an interval are counted as the difference
    of two running totals, so goals and players are never paired.
    """
    scope = ["match_id", "team"]
    off = changes.where("off_id IS NOT NULL").groupBy(*scope, F.col("off_id").alias("player_id")).agg(
        F.max_by("minute", "seq").alias("off"))
    on = changes.where("on_id IS NOT NULL").groupBy(*scope, F.col("on_id").alias("player_id")).agg(
        F.max_by("minute", "seq").alias("start"))
    began = lineups.select(*scope, "player_id", F.lit(0.0).alias("start"), F.lit(0).alias("late")).unionByName(
        on.withColumn("late", F.lit(1)))
    began = began.groupBy(*scope, "player_id").agg(F.max_by("start", "late").alias("start"))
    spells = cut(began.join(off, [*scope, "player_id"], "left").join(ends, "match_id").withColumn(
        "end", F.coalesce("off", "match_end")))
    marks = spells.select(*scope, "player_id", F.explode(F.array(
        F.struct(F.col("start").alias("minute"), F.lit(0).alias("kind")),
        F.struct(F.col("end").alias("minute"), F.lit(2).alias("kind")))).alias("m")).select(*scope, "player_id", "m.*")
    points = marks.unionByName(goals.select(*scope, F.lit(None).cast("string").alias("player_id"), "minute", F.lit(1).alias("kind")))
    points = points.withColumn("goal", (F.col("kind") == 1).cast("bigint"))
    counted = running_sums(points, scope, F.floor(F.col("minute") * 6), [F.col("minute"), F.col("kind")], {"upto": F.col("goal")})
    inside = counted.where("kind <> 1").groupBy(*scope, "player_id").agg(
        F.greatest(F.lit(0), F.sum(F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto")))).alias("goals_on"))
    total = goals.groupBy(*scope).agg(F.count("*").alias("team_goals"))
    return spells.join(inside, [*scope, "player_id"]).join(total, scope, "left").select(
        *scope, "player_id", F.greatest(F.lit(0.0), F.col("end") - F.col("start")).alias("on_min"), "goals_on",
        "match_end", F.coalesce("team_goals", F.lit(0)).alias("team_goals"))


def influence(per_match: DataFrame, min_on: float = 270.0, min_off: float = 90.0) -> DataFrame:
    """Team goals per 90 with and without the player, and their difference."""
    total = per_match.groupBy("team", "player_id").agg(
        F.sum("on_min").alias("on_minutes"), F.sum("goals_on").alias("goals_on"),
        (F.sum("match_end") - F.sum("on_min")).alias("off_minutes"), F.sum("team_goals").alias("team_goals"))
    out = total.where((F.col("on_minutes") >= min_on) & (F.col("off_minutes") >= min_off)).select(
        "team", "player_id", "on_minutes", "off_minutes", (F.col("goals_on") / F.col("on_minutes") * 90.0).alias("rate_on"),
        ((F.col("team_goals") - F.col("goals_on")) / F.col("off_minutes") * 90.0).alias("rate_off"))
    return out.withColumn("delta", F.col("rate_on") - F.col("rate_off"))


# --------------------------------------------------------------------------- #
# Behaviour
# --------------------------------------------------------------------------- #
def first_conceded(events: DataFrame) -> DataFrame:
    """First minute each side conceded in each match."""
    return events.where("type = 'goal'").groupBy(
        "match_id", F.when(F.col("team") == "HOME", "AWAY").otherwise("HOME").alias("team")).agg(
        F.min("minute").alias("conceded"))


#: Indices that the events of a match cannot support, and the signals that they would need.
NEVER_OBSERVED = (("leadership", "no_conduct_signals"), ("recovery", "no_defensive_actions"), ("tactical_discipline", "no_role_positions"))


def behaviour(player_profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Four behaviour indices per (match, side, player); null = abstained, with a reason (a code) in the map ``reasons``.

    ``reasons`` also has the indices that match events can never support.

    ``player_profiles`` has player_id and profile columns, ``events`` the match events.
    """
    e = salted_join(events, first_conceded(events), ["match_id", "team"], ["player_id", "minute"], "left")
    kind = F.col("type")
    per = e.groupBy("match_id", "team", "player_id").agg(
        F.count("*").alias("n"), F.count_if(kind == "foul").alias("fouls"),
        F.count_if(kind == "yellow_card").alias("yellows"), F.count_if(kind == "red_card").alias("reds"),
        F.count_if(F.col("minute") < F.col("conceded")).alias("before"),
        F.count_if(F.col("minute") >= F.col("conceded")).alias("after"),
        F.max("minute").alias("last"), F.min("conceded").alias("conceded"))
    out = per.join(player_profiles, "player_id")
    acts = F.when(F.coalesce("actions", F.lit(0)) > 0, F.col("actions")).otherwise(F.col("n"))
    rate = (F.col("fouls") + 2 * F.col("yellows") + 3 * F.col("reds")) / acts
    tiny = F.lit(1e-9)
    before = F.col("before") / F.greatest(F.col("conceded"), tiny)
    after = F.col("after") / F.greatest(F.col("last") - F.col("conceded"), tiny)
    unit = lambda c: clip(c, 0.0, 1.0)
    stability = unit(0.6 * F.col("pass_accuracy") + 0.4 * (1.0 - F.least(F.lit(1.0), F.col("turnover_rate") / REF_TURNOVER)))
    indices = {
        "decision_stability": F.when(F.col("pass_accuracy").isNotNull() & F.col("turnover_rate").isNotNull(), stability),
        "pressure_resistance": F.when(F.col("dribbles") >= MIN_DRIBBLES, F.when(
            F.col("dribble_success").isNotNull(), unit(F.col("dribble_success")))),
        "aggression_control": unit(1.0 - F.least(F.lit(1.0), rate / REF_DISCIPLINE)),
        "resilience": F.when(F.col("conceded").isNotNull() & (F.col("before") > 0), unit(F.try_divide(0.5 * after, before))),
    }
    why = {
        "decision_stability": F.lit("no_shares"),
        "pressure_resistance": F.when(F.coalesce("dribbles", F.lit(0)) < MIN_DRIBBLES, "few_dribbles").otherwise("no_dribble_success"),
        "aggression_control": F.lit("no_actions"),
        "resilience": F.when(F.col("conceded").isNull(), "nothing_conceded").otherwise("no_action_before"),
    }
    missing = [F.when(v.isNull(), F.struct(F.lit(k).alias("key"), why[k].alias("value"))) for k, v in indices.items()]
    always = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in NEVER_OBSERVED]
    out = out.select("match_id", "team", "player_id", *[v.alias(k) for k, v in indices.items()], "confidence",
                     F.map_from_entries(F.array_compact(F.array(*missing, *always))).alias("reasons"))
    return out.withColumn("abstained", F.array_compact(F.array(*[
        F.when(F.col(k).isNull(), F.lit(k)) for k in indices])))


def involvement(events: DataFrame, width: int = 15) -> DataFrame:
    """Actions per fixed window up to each player's last event, empty windows included."""
    keys = ["match_id", "player_id"]
    slot = F.floor(F.col("minute") / width).cast("int")
    counts = events.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("actions"))
    grid = counts.groupBy(*keys).agg(F.max("slot").alias("last")).select(
        *keys, F.explode(F.expr("sequence(0, last)")).alias("slot"))
    return grid.join(counts, [*keys, "slot"], "left").select(
        *keys, (F.col("slot") * width).alias("from_minute"), F.coalesce("actions", F.lit(0)).alias("actions"))


# --------------------------------------------------------------------------- #
# Scouting
# --------------------------------------------------------------------------- #
COMPONENTS = ("attack", "creation", "progression", "security")


def scout_pool(player_profiles: DataFrame, bios: DataFrame, on: Column, *, min_actions: int = MIN_ACTIONS,
               min_confidence: float = 0.0, max_age: float | None = None, position: str | None = None) -> DataFrame:
    """The eligible cohort with component rates and ages (unknown age stays unknown)."""
    p = player_profiles.where(F.col("actions") >= min_actions)
    if min_confidence:
        p = p.where(F.col("confidence") >= min_confidence)
    p = p.join(bios.select("player_id", "birth_date", F.col("position").alias("bio_position")), "player_id", "left")
    if position:
        hay = F.lower(F.concat_ws(" ", "position", "bio_position"))
        p = p.where(F.contains(hay, F.lit(position.lower())))
    p = p.withColumn("age", age_on(F.col("birth_date"), on))
    if max_age is not None:
        p = p.where(F.col("age") <= max_age)
    acts = F.greatest(F.col("actions"), F.lit(1))
    return p.select("player_id", "actions", "confidence", "age",
                    ((F.col("goals") + F.col("assists")) / acts).alias("attack"), F.col("key_pass_rate").alias("creation"),
                    F.col("progressive_pass_share").alias("progression"),
                    (F.col("pass_accuracy") - F.col("turnover_rate")).alias("security"))


def scout_ranking(pool: DataFrame, cohort: list[str] = []) -> DataFrame:
    """Composite score from cohort percentiles, evidence and age, in full precision.

    Order by (score desc, player_id) for the ranking; views round the score to one digit.
    """
    pool = cut(pool)
    long = pool.unpivot(["player_id", *cohort], list(COMPONENTS), "component", "value")
    ranked = mid_rank(long, [*cohort, "component"], "value", "pct")
    wide = ranked.groupBy("player_id", *cohort).agg(*[
        F.max(F.when(F.col("component") == c, F.col("pct"))).alias(f"pct_{c}") for c in COMPONENTS])
    out = pool.join(wide, ["player_id", *cohort])
    parts = [F.col(f"pct_{c}") for c in COMPONENTS]
    performance = sum(parts[1:], parts[0]) / len(COMPONENTS)
    weight = 0.5 + 0.5 * clip(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0)
    return out.withColumn("performance", performance).withColumn("age_factor", age_factor(F.col("age"))).withColumn(
        "score", F.least(F.lit(100.0), 100.0 * F.col("performance") * weight * F.col("age_factor")))


def season_timeline(season_profiles: DataFrame, matches: DataFrame) -> DataFrame:
    """Each player's seasons ordered by the season's first match date."""
    starts = matches.groupBy("competition", "season").agg(F.min("match_date").alias("first_match_date"))
    rows = season_profiles.join(starts, ["competition", "season"], "left")
    return numbered(rows, ["player_id"], F.coalesce(F.year("first_match_date"), F.lit(0)),
                    [F.coalesce(F.col("first_match_date").cast("string"), F.lit("")), F.col("competition"), F.col("season")], "season_no")
