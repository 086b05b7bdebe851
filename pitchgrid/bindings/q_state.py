"""Queries: snapshots, panel and their window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings import state_sql as Q
from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import match_events, matches
from pitchgrid.functions.scoring import prob_at_least
from pitchgrid.operators.grid import game_cells, game_grid
from pitchgrid.plans import snapshots as S
from pitchgrid.settings import Params

EV = ("match_events",)
SNAP = Q.SNAPSHOTS
PANEL = Q.PANEL


@query("m01_snapshots", SNAP + """ SELECT match_id, t AS minute, regime, R(momentum) AS momentum,
  home_goals, away_goals, R(press_home) AS press_home_0, R(press_away) AS press_away_0, recent_shots,
  R(lam_home) AS lam_home, R(lam_away) AS lam_away, R(prob) AS prob, happened::BIGINT AS happened FROM snaps""", EV)
def m01(spark, d):
    return S.snapshots(match_events(spark, d))


def _panel(spark, d):
    return S.panel(match_events(spark, d))


@query("m15_panel", PANEL + f""" SELECT match_id, t AS minute, home_goals, away_goals, n_events, regime, previous_regime,
  R(instability) AS instability, R(momentum) AS momentum, recent_shots, R(press_home) AS pressure_home,
  R(press_away) AS pressure_away, R(lam_home) AS lam_home, R(lam_away) AS lam_away,
  R(1 - exp(-lam * 5)) AS goal_next_5min, R(1 - exp(-lam * 10)) AS goal_next_10min,
  R(1 - exp(-lam * greatest(0, CASE WHEN t < 45 THEN 45 ELSE 90 END - t))) AS goal_before_half,
  R(lam_home / lam) AS next_goal_home, R(confidence) AS confidence, change_score,
  {Q.BECAUSE} AS because, (confidence <= 0.66)::BIGINT AS tentative FROM panels""", EV)
def m15(spark, d):
    return _panel(spark, d)


@query("a01_score_at_minute", PANEL + " SELECT match_id, t AS minute, home_goals, away_goals FROM panels", EV)
def a01(spark, d):
    return _panel(spark, d).select("match_id", "minute", "home_goals", "away_goals")


@query("p10_goal_difference_by_side", PANEL + """ SELECT match_id, t AS minute, side,
  CASE WHEN side = 'HOME' THEN home_goals - away_goals ELSE away_goals - home_goals END AS goal_diff
  FROM panels, (VALUES ('HOME'), ('AWAY')) v(side)""", EV)
def p10(spark, d):
    from pitchgrid.functions.clock import goal_difference
    side = F.explode(F.array(F.lit("HOME"), F.lit("AWAY")))
    return _panel(spark, d).select("match_id", "minute", side.alias("side"), "home_goals", "away_goals").select(
        "match_id", "minute", "side", goal_difference(F.col("side"), F.col("home_goals"), F.col("away_goals")).alias("goal_diff"))


@query("w01_w02_pressure_momentum", PANEL + """ SELECT match_id, t AS minute, R(press_home) AS pressure_home,
  R(press_away) AS pressure_away, R(momentum) AS momentum_home, R(1 - momentum) AS momentum_away,
  R(momentum) AS control_home, R(press_away) AS vulnerability_home, R(press_home) AS vulnerability_away FROM panels""", EV)
def w01(spark, d):
    p = _panel(spark, d)
    return p.select("match_id", "minute", "pressure_home", "pressure_away", F.col("momentum").alias("momentum_home"),
                    (1 - F.col("momentum")).alias("momentum_away"), F.col("momentum").alias("control_home"),
                    F.col("pressure_away").alias("vulnerability_home"), F.col("pressure_home").alias("vulnerability_away"))


def _grid(spark, d, step=1, taus=(8.0,)):
    return game_grid(game_cells(match_events(spark, d), step, taus, {}), step, taus, {})


@query("w03_minutes_since_goal_and_red", PANEL + """ SELECT match_id, t AS minute, R(t - last_goal) AS since_goal,
  coalesce(t - last_red <= 10, false)::BIGINT AS red_in_last_10 FROM panels""", EV)
def w03(spark, d):
    return _grid(spark, d).select("match_id", F.col("t").alias("minute"), (F.col("t") - F.col("last_goal")).alias("since_goal"),
                                  F.coalesce(F.col("t") - F.col("last_red") <= 10, F.lit(False)).alias("red_in_last_10"))


@query("w04_w05_regime_instability", PANEL + """ SELECT match_id, t AS minute, regime, previous_regime,
  coalesce(previous_regime <> regime, false)::BIGINT AS changed FROM panels""", EV)
def w04(spark, d):
    return _panel(spark, d).select("match_id", "minute", "regime", "previous_regime",
                                   (F.col("instability") > 0).alias("changed"))


@query("w07_red_card_multiplier", PANEL + """ SELECT match_id, t AS minute, reds_home, reds_away,
  R(greatest(0, 1 + 0.2 * reds_away) * greatest(0, 1 - 0.15 * reds_home)) AS factor_home,
  R(greatest(0, 1 + 0.2 * reds_home) * greatest(0, 1 - 0.15 * reds_away)) AS factor_away FROM panels""", EV)
def w07(spark, d):
    rh, ra = F.col("reds_home"), F.col("reds_away")
    return _grid(spark, d).select("match_id", F.col("t").alias("minute"), rh, ra, S.card_effect(rh, ra).alias("factor_home"),
                                  S.card_effect(ra, rh).alias("factor_away"))


@query("w08_recent_shots", PANEL + " SELECT match_id, t AS minute, recent_shots FROM panels", EV)
def w08(spark, d):
    return _panel(spark, d).select("match_id", "minute", "recent_shots")


@query("f07_poisson_tail", PANEL + """ SELECT match_id, t AS minute, R(1 - exp(-lam * 45)) AS at_least_1,
  R(greatest(0, 1 - exp(-lam * 45) * (1 + lam * 45))) AS at_least_2,
  R(greatest(0, 1 - exp(-lam * 45) * (1 + lam * 45 + (lam * 45) ** 2 / 2))) AS at_least_3 FROM panels""", EV)
def f07(spark, d):
    mean = (F.col("lam_home") + F.col("lam_away")) * 45
    return _panel(spark, d).select("match_id", "minute", *[prob_at_least(mean, k).alias(f"at_least_{k}") for k in (1, 2, 3)])


@query("f08_coach_rates", PANEL + """ SELECT match_id, t AS minute,
  R(0.015 * (0.5 + momentum) * clock * CASE WHEN home_goals > away_goals THEN 0.85 WHEN home_goals < away_goals THEN 1.2 ELSE 1 END
    * greatest(0, 1 + 0.2 * reds_away) * greatest(0, 1 - 0.15 * reds_home)) AS lam_home,
  R(lam_away) AS lam_away FROM panels""", EV)
def f08(spark, d):
    return S.coach_rates(_grid(spark, d), Params(), {"HOME": {"winning": "retreat", "losing": "press"}})


@query("f09_predictions", PANEL + """ SELECT match_id, t AS minute, R(1 - exp(-lam * 5)) AS goal_next_5min,
  R(1 - exp(-lam * 10)) AS goal_next_10min,
  R(1 - exp(-lam * greatest(0, CASE WHEN t < 45 THEN 45 ELSE 90 END - t))) AS goal_before_half,
  R(lam_home / lam) AS next_goal_home, R(1 - lam_home / lam) AS next_goal_away FROM panels""", EV)
def f09(spark, d):
    return _panel(spark, d).select("match_id", "minute", "goal_next_5min", "goal_next_10min", "goal_before_half",
                                   "next_goal_home", (1 - F.col("next_goal_home")).alias("next_goal_away"))


@query("f10_change_score", Q.PANEL_GRID + "," + Q.state() + """ SELECT match_id, t AS minute,
  round_even(100 * least(1, 1.25 * (0.6 * abs(momentum - 0.6) + 0.4 * CASE WHEN home_goals > away_goals THEN 0.0
    WHEN home_goals = away_goals THEN 0.5 ELSE 1.0 END)), 0)::BIGINT AS change_score FROM read""", EV)
def f10(spark, d):
    return S.panel(match_events(spark, d), expected_home=0.6).select("match_id", "minute", "change_score")


@query("f23_player_aware_rate", PANEL + """ SELECT match_id, t AS minute, R(lam_home * 1.08 * 0.97) AS lam_home,
  R(lam_home) AS collective FROM panels""", EV)
def f23(spark, d):
    return _panel(spark, d).select("match_id", "minute", S.player_aware_rate(F.col("lam_home"), F.lit(1.08), F.lit(0.97)).alias("lam_home"),
                                   F.col("lam_home").alias("collective"))


@query("a35_confidence", PANEL + " SELECT match_id, t AS minute, n_events, R(confidence) AS confidence FROM panels", EV)
def a35(spark, d):
    return _panel(spark, d).select("match_id", "minute", "n_events", "confidence")


@query("f05_explanations", PANEL.rstrip() + f""" SELECT match_id, minute, control, CASE WHEN control <> 'even' THEN side END AS control_team, control_percent, outlook, outlook_percent,
    next_goal_team, next_goal_percent FROM (SELECT p.match_id, t AS minute, CASE WHEN momentum >= 0.5 THEN home_team ELSE away_team END AS side,
  CASE WHEN greatest(momentum, 1 - momentum) > 0.72 THEN 'dominant' WHEN greatest(momentum, 1 - momentum) > 0.58 THEN 'ahead' ELSE 'even' END AS control,
  {Q.PCT.format('greatest(momentum, 1 - momentum)')} AS control_percent,
  CASE WHEN 1 - exp(-lam * 10) >= 0.45 THEN 'likely' WHEN 1 - exp(-lam * 10) >= 0.25 THEN 'possible' ELSE 'quiet' END AS outlook,
  {Q.PCT.format('1 - exp(-lam * 10)')} AS outlook_percent, CASE WHEN lam_home / lam >= 0.5 THEN home_team ELSE away_team END AS next_goal_team,
  {Q.PCT.format('greatest(lam_home / lam, 1 - lam_home / lam)')} AS next_goal_percent
  FROM panels p JOIN matches m ON m.match_id = p.match_id)""", ("match_events", "matches"))
def f05(spark, d):
    names = matches(spark, d).select("match_id", F.col("home_team").alias("home"), F.col("away_team").alias("away"))
    return S.reading_codes(_panel(spark, d).join(names, "match_id")).select(
        "match_id", "minute", "control", "control_team", "control_percent", "outlook", "outlook_percent", "next_goal_team", "next_goal_percent")


@query("f05_situation_codes", PANEL.rstrip() + f""" SELECT p.match_id, t AS minute, regime AS situation, CASE regime WHEN 'PRESSURE' THEN CASE WHEN momentum >= 0.5 THEN home_team ELSE away_team END
    WHEN 'DESPERATION' THEN CASE WHEN p.home_goals > p.away_goals THEN away_team ELSE home_team END END AS situation_team,
  'goal_next_10min ' || {Q.PCT.format('1 - exp(-lam * 10)')} AS header, CASE WHEN confidence <= 0.66 THEN 'tentative' END AS note
  FROM panels p JOIN matches m ON m.match_id = p.match_id""", ("match_events", "matches"))
def f05_situation(spark, d):
    names = matches(spark, d).select("match_id", F.col("home_team").alias("home"), F.col("away_team").alias("away"))
    return S.situation_codes(_panel(spark, d).join(names, "match_id"))


@query("f05_log_lines", """ SELECT event_id, match_id, floor(minute)::BIGINT || ' ' || type || ' ' || team AS line FROM match_events WHERE type IN ('goal', 'yellow_card', 'red_card')""", ("match_events",))
def f05_log(spark, d):
    return S.log_lines(match_events(spark, d)).select("event_id", "match_id", "line")


@query("m12_leakage_audit", """SELECT m.match_id, c::BIGINT AS minute, 1::BIGINT AS variants, 2::BIGINT AS n
  FROM matches m, unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) u(c)""", ("matches",))
def m12(spark, d):
    heads = matches(spark, d).select("match_id", "duration")
    return S.leakage_audit(match_events(spark, d), [10, 20, 30, 40, 50, 60, 70, 80, 90], headers=heads)


@query("f19_likely_causes", PANEL + """ SELECT match_id, t AS minute, concat_ws('|',
  CASE WHEN n_events / greatest(t, 1) < 0.7 THEN 'few_passes' END,
  CASE WHEN recent_shots >= 2 THEN 'marked' END, CASE WHEN previous_regime <> regime THEN 'moved' END,
  CASE WHEN momentum < 0.4 THEN 'midfield_lost' END) AS causes FROM panels""", EV)
def f19(spark, d):
    p = _panel(spark, d)
    return p.select("match_id", "minute", S.likely_causes(
        F.col("n_events") / F.greatest("minute", F.lit(1)), F.col("recent_shots"), F.col("instability") > 0,
        F.col("momentum")).alias("causes"))


@query("f17_regime_scaled_rates", SNAP + """ SELECT match_id, t AS minute, regime,
  R(lam_home * CASE regime WHEN 'PRESSURE' THEN 1.25 WHEN 'END_GAME' THEN 0.9 ELSE 1 END) AS lam_home FROM snaps""", EV)
def f17(spark, d):
    return S.snapshots(match_events(spark, d), Params(regime_scale={"PRESSURE": 1.25, "END_GAME": 0.9})).select(
        "match_id", "minute", "regime", "lam_home")


@query("j06_events_up_to_minute", PANEL + " SELECT match_id, t AS minute, n_events FROM panels", EV)
def j06(spark, d):
    """Events with minute <= t for every grid minute, without a range join."""
    return _grid(spark, d).select("match_id", F.col("t").alias("minute"), "n_events")


@query("j07_goal_in_window", SNAP + " SELECT match_id, t AS minute, happened::BIGINT AS happened FROM snaps", EV)
def j07(spark, d):
    return S.snapshots(match_events(spark, d)).select("match_id", "minute", "happened")


@query("j17_previous_regime", PANEL + " SELECT match_id, t AS minute, previous_regime FROM panels", EV)
def j17(spark, d):
    return _panel(spark, d).select("match_id", "minute", "previous_regime")


@query("g02_injected_scorer", PANEL + """ SELECT match_id, R(avg(lam_home * 90)) AS strength, R(abs(avg(lam_home * 90) - avg(momentum * 2))) AS divergence FROM panels GROUP BY match_id""", EV)
def g02(spark, d):
    """Perception and reality scorers are caller-supplied column expressions."""
    from pitchgrid.plans.narrative import divergence_index
    return divergence_index(_panel(spark, d), ["match_id"], perception=F.avg(F.col("momentum") * 2), reality=F.avg(F.col("lam_home") * 90)).select(
        "match_id", F.col("reality").alias("strength"), "divergence")
