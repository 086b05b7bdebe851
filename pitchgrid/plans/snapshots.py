"""Minute-by-minute game state for every match in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.scoring import clip, geometric_confidence, prob_within
from pitchgrid.operators.grid import game_cells, game_grid, with_recent_shots
from pitchgrid.settings import (
    CARD_TYPES, CAUSE_LEVELS, CONTROL_LEVELS, LATE_MINUTE, OUTLOOK_LEVELS, POST_GOAL_MINUTES, POST_RED_MINUTES, RECENT_SHOT_MINUTES, REGIME_LOOKBACK,
    TRANSITION_INSTABILITY, Params,
)

GOAL_TARGET = {"goal": ("goal",)}


def momentum(home: Column, away: Column) -> Column:
    """Home share of decayed pressure; exactly 0.5 when nobody pressed."""
    total = home + away
    return F.when(total == 0, 0.5).otherwise(F.try_divide(home, total))


def regime(mom: Column, params: Params) -> Column:
    """Six game states; the first matching rule wins."""
    t = F.col("t")
    return (
        F.when(t - F.col("last_goal") < POST_GOAL_MINUTES, "POST_GOAL")
        .when(t - F.col("last_red") <= POST_RED_MINUTES, "POST_RED_CARD")
        .when((t > LATE_MINUTE) & (F.col("home_goals") != F.col("away_goals")), "DESPERATION")
        .when(t > LATE_MINUTE, "END_GAME")
        .when(F.greatest(mom, 1 - mom) > params.pressure_threshold, "PRESSURE")
        .otherwise("NORMAL")
    )


def score_effect(own: Column, other: Column, profile: dict | None = None) -> Column:
    """Rate factor of the score; a coach profile replaces the default effect."""
    if profile is None:
        return F.when(own > other, 0.9).when(own < other, 1.1).otherwise(1.0)
    leading = 0.85 if profile.get("winning") == "retreat" else 1.0
    trailing = 1.20 if profile.get("losing") == "press" else 1.0
    return F.when(own > other, leading).when(own < other, trailing).otherwise(1.0)


def time_effect(t: Column) -> Column:
    distance = F.least(F.abs(t - 45.0), F.abs(t - 90.0))
    return 1.0 + 0.4 * F.exp(-distance / 6.0)


def card_effect(own: Column, other: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 + 0.20 * other) * F.greatest(F.lit(0.0), 1.0 - 0.15 * own)


def unit_rates(mom: Column, profiles: dict | None = None) -> tuple[Column, Column]:
    """Both goal rates per minute for base rate 1."""
    profiles = profiles or {}
    h, a = F.col("home_goals"), F.col("away_goals")
    rh, ra = F.col("reds_home"), F.col("reds_away")
    clock = time_effect(F.col("t"))
    home = (0.5 + mom) * score_effect(h, a, profiles.get("HOME")) * clock * card_effect(rh, ra)
    away = (1.5 - mom) * score_effect(a, h, profiles.get("AWAY")) * clock * card_effect(ra, rh)
    return home, away


def lookup_scale(kind: Column, scale: dict) -> Column:
    if not scale:
        return F.lit(1.0)
    pairs = [F.lit(v) for kv in sorted(scale.items()) for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(1.0))


def read_state(grid: DataFrame, params: Params, profiles: dict | None = None) -> DataFrame:
    """Momentum, regime and goal rates on a one-tau grid."""
    mom = momentum(F.col("press_home_0"), F.col("press_away_0"))
    out = grid.withColumn("momentum", mom)
    out = out.withColumn("regime", regime(F.col("momentum"), params))
    scale = params.base_rate * lookup_scale(F.col("regime"), params.regime_scale)
    home, away = unit_rates(F.col("momentum"), profiles)
    return out.withColumn("lam_home", scale * home).withColumn("lam_away", scale * away)


def happened_within(target: str, window: int) -> Column:
    """1 if the target happens in (t, t + window]."""
    return F.coalesce((F.col(f"next_{target}") <= F.col("t") + window).cast("int"), F.lit(0))


def evaluation_end(step: int, window: int) -> Column:
    """Last grid minute that leaves a full outcome window, at least one step."""
    return F.greatest(F.lit(step), F.floor((F.col("duration") - window) / step) * step)


def snapshot_grid(
    events: DataFrame, params: Params = Params(), *, window: int = 10, step: int = 5,
    headers: DataFrame | None = None, taus: tuple | None = None, targets: dict | None = None,
) -> DataFrame:
    """Grid rows t = step, 2·step, … with raw state and next-event minutes."""
    taus = taus or (params.tau,)
    targets = targets or GOAL_TARGET
    cells = game_cells(events, step, taus, targets)
    grid = game_grid(cells, step, taus, targets, evaluation_end(step, window), headers)
    return with_recent_shots(grid, step, RECENT_SHOT_MINUTES).where(F.col("t") >= step)


def snapshots(events: DataFrame, params: Params = Params(), *, window: int = 10, step: int = 5,
              headers: DataFrame | None = None) -> DataFrame:
    """Leakage-safe prediction and resolved outcome per (match, minute)."""
    grid = snapshot_grid(events, params, window=window, step=step, headers=headers)
    out = read_state(grid, params)
    return out.select(
        "match_id", F.col("t").alias("minute"), "regime", "momentum", "home_goals", "away_goals",
        "press_home_0", "press_away_0", "recent_shots", "lam_home", "lam_away",
        prob_within(F.col("lam_home") + F.col("lam_away"), window).alias("prob"),
        happened_within("goal", window).alias("happened"),
    )


# --------------------------------------------------------------------------- #
# The full panel
# --------------------------------------------------------------------------- #
SOURCE_QUALITY = 0.95
SOURCE_AGREEMENT = 1.0
SIMILAR_CASES = 50
FIRM_CONFIDENCE = 0.66


def percent(value: Column) -> Column:
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def change_score(expected_home: float, mom: Column, home: Column, away: Column) -> Column:
    """0..100 distance between the picture on the pitch and the expectation."""
    lead = F.signum((home - away).cast("double"))
    expected = F.lit(float((expected_home > 0.5) - (expected_home < 0.5)))
    lead_gap = F.when(lead == expected, 0.0).when((lead == 0) | (expected == 0), 0.5).otherwise(1.0)
    raw = 0.6 * F.abs(mom - expected_home) + 0.4 * lead_gap
    return F.bround(100 * F.least(F.lit(1.0), 1.25 * raw), 0).cast("int")


def mechanisms(threshold: float = 0.65) -> Column:
    """Readable reasons, each with a fixed trigger."""
    t, mom = F.col("minute"), F.col("momentum")
    share = F.greatest(mom, 1 - mom)
    side = F.when(mom >= 0.5, "HOME").otherwise("AWAY")
    behind = F.when(F.col("home_goals") > F.col("away_goals"), "AWAY").otherwise("HOME")
    return F.array_compact(F.array(
        F.when(share > threshold, F.concat(side, F.lit(" holds "), percent(share), F.lit(" of the recent pressure"))),
        F.when(F.col("recent_shots") >= 3, F.concat(F.col("recent_shots").cast("string"), F.lit(" shots in 10 minutes"))),
        F.when((F.col("home_goals") != F.col("away_goals")) & (t > 75), F.concat(behind, F.lit(" is behind with little time left"))),
    ))


def panel_from_grid(grid: DataFrame, params: Params = Params(), *, step: int = 1,
                    expected_home: float = 0.5, profiles: dict | None = None) -> DataFrame:
    """Panel rows from a grid that starts at minute 0; exact doubles, no rounding."""
    if REGIME_LOOKBACK % step:
        raise ValueError("the grid step must divide the regime look-back")
    along = Window.partitionBy("match_id").orderBy("t")
    state = read_state(with_recent_shots(grid, step, RECENT_SHOT_MINUTES), params, profiles)
    state = state.withColumn("previous_regime", F.lag("regime", REGIME_LOOKBACK // step).over(along))
    state = state.withColumn("instability", F.when(
        F.col("previous_regime") != F.col("regime"), TRANSITION_INSTABILITY).otherwise(0.0))
    lam = F.col("lam_home") + F.col("lam_away")
    t = F.col("t")
    half = F.greatest(F.lit(0.0), F.when(t < 45, 45.0).otherwise(90.0) - t)
    out = state.select(
        "match_id", t.alias("minute"), "home_goals", "away_goals", "n_events", "regime",
        "previous_regime", "instability", "momentum", "recent_shots",
        F.col("press_home_0").alias("pressure_home"), F.col("press_away_0").alias("pressure_away"),
        "lam_home", "lam_away",
        prob_within(lam, 5).alias("goal_next_5min"), prob_within(lam, 10).alias("goal_next_10min"),
        prob_within(lam, half).alias("goal_before_half"),
        F.when(lam == 0, 0.5).otherwise(F.try_divide(F.col("lam_home"), lam)).alias("next_goal_home"),
        geometric_confidence(F.col("n_events"), SOURCE_QUALITY, SOURCE_AGREEMENT,
                             F.col("instability"), SIMILAR_CASES).alias("confidence"),
        change_score(expected_home, F.col("momentum"), F.col("home_goals"), F.col("away_goals")).alias("change_score"),
    )
    shifted = F.when(F.col("instability") > 0, F.concat(
        F.lit("the game shifted at minute "), F.col("minute").cast("string")))
    return out.withColumn(
        "because", F.concat(F.array_compact(F.array(shifted)), mechanisms())
    ).withColumn("tentative", F.col("confidence") <= FIRM_CONFIDENCE)


def panel(events: DataFrame, params: Params = Params(), *, step: int = 1, headers: DataFrame | None = None,
          last: Column | None = None, expected_home: float = 0.5) -> DataFrame:
    """The complete reading of every match at every grid minute from kick-off."""
    cells = game_cells(events, step, (params.tau,), {})
    grid = game_grid(cells, step, (params.tau,), {}, last, headers)
    return panel_from_grid(grid, params, step=step, expected_home=expected_home)


def reading_codes(panels: DataFrame) -> DataFrame:
    """What a panel row says, as codes and values (needs home, away); sentences are the caller's.

    ``control`` and ``outlook`` are levels, ``control_team`` and ``next_goal_team`` the sides
    they are about (none when even), the ``*_percent`` columns their displayed shares.
    """
    mom = F.col("momentum")
    share = F.greatest(mom, 1 - mom)
    control = F.when(share > CONTROL_LEVELS[1], "dominant").when(share > CONTROL_LEVELS[0], "ahead").otherwise("even")
    p10 = F.col("goal_next_10min")
    return panels.withColumns({
        "control": control,
        "control_team": F.when(control != "even", F.when(mom >= 0.5, F.col("home")).otherwise(F.col("away"))),
        "control_percent": percent(share),
        "outlook": F.when(p10 >= OUTLOOK_LEVELS[1], "likely").when(p10 >= OUTLOOK_LEVELS[0], "possible").otherwise("quiet"),
        "outlook_percent": percent(p10),
        "next_goal_team": F.when(F.col("next_goal_home") >= 0.5, F.col("home")).otherwise(F.col("away")),
        "next_goal_percent": percent(F.greatest("next_goal_home", 1 - F.col("next_goal_home")))})


def situation_codes(panels: DataFrame, window: int = 10) -> DataFrame:
    """The situation line, header and note of a panel row (needs home, away), as codes and values.

    ``situation`` is the regime, ``situation_team`` the team that it is about: the one on top under pressure, the one
    behind (the home team when level) in desperation, else none. ``header`` is the claim's share in percent for the next
    ``window`` minutes, ``note`` is ``tentative`` at or below the firm confidence.
    """
    on_top = F.when(F.col("momentum") >= 0.5, F.col("home")).otherwise(F.col("away"))
    behind = F.when(F.col("home_goals") > F.col("away_goals"), F.col("away")).otherwise(F.col("home"))
    team = F.when(F.col("regime") == "PRESSURE", on_top).when(F.col("regime") == "DESPERATION", behind)
    return panels.select(
        "match_id", "minute", F.col("regime").alias("situation"), team.alias("situation_team"),
        F.concat(F.lit(f"goal_next_{window}min "), percent(F.col(f"goal_next_{window}min"))).alias("header"),
        F.when(F.col("confidence") <= FIRM_CONFIDENCE, "tentative").alias("note"))


def log_lines(events: DataFrame) -> DataFrame:
    """Goals and cards as log lines: whole minute, type and team."""
    return events.where(F.col("type").isin("goal", *CARD_TYPES)).withColumn(
        "line", F.concat_ws(" ", F.floor("minute").cast("string"), "type", "team"))


def leakage_audit(events: DataFrame, cutoffs: list[int], params: Params = Params(), *, step: int = 1,
                  headers: DataFrame | None = None) -> DataFrame:
    """Panels at each cutoff computed from the full and from the truncated stream.

    Empty result = erasing the future changes nothing. Both variants are one plan: the
    truncated streams are the events repeated once per later cutoff, told apart by an
    extended match id.
    """
    last = F.lit(max(cutoffs))
    full = panel(events, params, step=step, headers=headers, last=last).where(F.col("minute").isin(*cutoffs))
    marks = F.array(*[F.lit(c) for c in sorted(cutoffs)])
    copies = events.withColumn("cutoff", F.explode(F.filter(marks, lambda c: c >= F.col("minute"))))
    copies = copies.withColumn("match_id", F.concat_ws("@", "match_id", F.col("cutoff").cast("string")))
    heads = headers
    if headers is not None:
        heads = headers.withColumn("cutoff", F.explode(marks)).withColumn(
            "match_id", F.concat_ws("@", "match_id", F.col("cutoff").cast("string")))
    cut = panel(copies, params, step=step, headers=heads, last=last)
    cut = cut.where(F.substring_index("match_id", "@", -1).cast("int") == F.col("minute"))
    cut = cut.withColumn("match_id", F.expr("substring(match_id, 1, length(match_id) - length(minute) - 1)"))
    compared = [c for c in full.columns if c != "because"]
    return (
        full.select(*compared, F.to_json("because").alias("because"), F.lit("full").alias("stream"))
        .unionByName(cut.select(*compared, F.to_json("because").alias("because"), F.lit("cut").alias("stream")))
        .groupBy("match_id", "minute")
        .agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("~"))
                                         for c in [*compared[2:], "because"]])).alias("variants"),
             F.count("*").alias("n"))
    )


def coach_rates(grid: DataFrame, params: Params, profiles: dict) -> DataFrame:
    """Rates with coach-specific score effects."""
    return read_state(grid, params, profiles).select(
        "match_id", F.col("t").alias("minute"), "lam_home", "lam_away")


def player_aware_rate(rate: Column, lineup: Column, network: Column) -> Column:
    return rate * lineup * network


def likely_causes(passes_rel: Column, markers: Column, moved: Column, midfield: Column) -> Column:
    """Codes of the triggered causes in fixed order; null inputs trigger nothing."""
    return F.array_compact(F.array(
        F.when(passes_rel < CAUSE_LEVELS["few_passes"], "few_passes"), F.when(markers >= CAUSE_LEVELS["marked"], "marked"),
        F.when(moved, "moved"), F.when(midfield < CAUSE_LEVELS["midfield_lost"], "midfield_lost")))


__all__ = ["clip", "snapshots", "snapshot_grid", "panel", "panel_from_grid", "reading_codes", "leakage_audit"]
