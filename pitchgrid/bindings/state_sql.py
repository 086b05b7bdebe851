"""SQL definitions of the game state: every event up to t, joined per grid minute."""

from __future__ import annotations

WEIGHT = ("CASE e.type WHEN 'shot_on_target' THEN 3.0 WHEN 'shot' THEN 1.5 "
          "WHEN 'dangerous_attack' THEN 1.0 WHEN 'corner' THEN 1.2 ELSE 0.0 END::DOUBLE")

SNAPSHOT_GRID = """
grid AS (
  SELECT match_id, duration, unnest(range(5, greatest(5, (duration - 10) // 5 * 5) + 1, 5)) AS t
  FROM (SELECT match_id, (floor(max(minute)) + 1)::BIGINT AS duration FROM match_events GROUP BY 1))"""

PANEL_GRID = """
grid AS (
  SELECT match_id, duration, unnest(range(0, ceil(last_minute)::BIGINT + 1, 1)) AS t
  FROM (SELECT match_id, (floor(max(minute)) + 1)::BIGINT AS duration, max(minute) AS last_minute
        FROM match_events GROUP BY 1))"""


def state(tau: str = "8.0", base: str = "0.015", grid: str = "grid", events: str = "match_events",
          prefix: str = "", extra: str = "") -> str:
    """CTEs {prefix}state, {prefix}read: one row per grid minute with rates and regime."""
    p = prefix
    x = f", {extra}" if extra else ""
    gx = f", g.{extra}" if extra else ""
    return f"""
{p}state AS (
  SELECT g.match_id, g.t, any_value(g.duration) AS duration{gx},
    count(e.event_id) AS n_events,
    count(e.event_id) FILTER (e.type = 'goal' AND e.team = 'HOME') AS home_goals,
    count(e.event_id) FILTER (e.type = 'goal' AND e.team = 'AWAY') AS away_goals,
    count(e.event_id) FILTER (e.type = 'red_card' AND e.team = 'HOME') AS reds_home,
    count(e.event_id) FILTER (e.type = 'red_card' AND e.team = 'AWAY') AS reds_away,
    max(e.minute) FILTER (e.type = 'goal') AS last_goal,
    max(e.minute) FILTER (e.type = 'red_card') AS last_red,
    count(e.event_id) FILTER (e.type IN ('shot', 'shot_on_target') AND g.t - e.minute <= 10) AS recent_shots,
    coalesce(sum({WEIGHT} * exp((e.minute - g.t) / {tau}::DOUBLE)) FILTER (e.team = 'HOME'), 0) AS press_home,
    coalesce(sum({WEIGHT} * exp((e.minute - g.t) / {tau}::DOUBLE)) FILTER (e.team = 'AWAY'), 0) AS press_away
  FROM {grid} g LEFT JOIN {events} e ON e.match_id = g.match_id AND e.minute <= g.t
  GROUP BY g.match_id, g.t{gx}),
{p}mom AS (
  SELECT *, CASE WHEN press_home + press_away = 0 THEN 0.5 ELSE press_home / (press_home + press_away) END AS momentum
  FROM {p}state),
{p}reg AS (
  SELECT *, CASE WHEN t - last_goal < 5 THEN 'POST_GOAL' WHEN t - last_red <= 10 THEN 'POST_RED_CARD'
      WHEN t > 80 AND home_goals <> away_goals THEN 'DESPERATION' WHEN t > 80 THEN 'END_GAME'
      WHEN greatest(momentum, 1 - momentum) > 0.65 THEN 'PRESSURE' ELSE 'NORMAL' END AS regime,
    1 + 0.4 * exp(-least(abs(t - 45), abs(t - 90)) / 6.0::DOUBLE) AS clock
  FROM {p}mom),
{p}read AS (
  SELECT *,
    (0.5 + momentum) * CASE WHEN home_goals > away_goals THEN 0.9 WHEN home_goals < away_goals THEN 1.1 ELSE 1.0 END
      * clock * greatest(0, 1 + 0.2 * reds_away) * greatest(0, 1 - 0.15 * reds_home) AS unit_home,
    (1.5 - momentum) * CASE WHEN away_goals > home_goals THEN 0.9 WHEN away_goals < home_goals THEN 1.1 ELSE 1.0 END
      * clock * greatest(0, 1 + 0.2 * reds_home) * greatest(0, 1 - 0.15 * reds_away) AS unit_away,
    {base}::DOUBLE * unit_home AS lam_home, {base}::DOUBLE * unit_away AS lam_away
  FROM {p}reg)"""


def outcome(types: str = "'goal'", window: int = 10) -> str:
    """Correlated flag: the target happens in (t, t + window]."""
    return (f"(SELECT count(*) > 0 FROM match_events f WHERE f.match_id = r.match_id AND f.type IN ({types}) "
            f"AND f.minute > r.t AND f.minute <= r.t + {window})::INTEGER")


SNAPSHOTS = SNAPSHOT_GRID + "," + state() + f""",
snaps AS (
  SELECT r.*, 1 - exp(-(lam_home + lam_away) * 10) AS prob, {outcome()} AS happened FROM read r)"""

CHANGE = """
  round_even(100 * least(1, 1.25 * (0.6 * abs(momentum - 0.5)
    + 0.4 * CASE WHEN home_goals = away_goals THEN 0.0 ELSE 0.5 END)), 0)::BIGINT"""

PANEL = PANEL_GRID + "," + state() + f""",
panels AS (
  SELECT *, CASE WHEN previous_regime <> regime THEN 0.6 ELSE 0.0 END AS instability,
    lam_home + lam_away AS lam,
    (least(1.0, n_events / 40.0::DOUBLE) * 0.95 * 1.0 * (1 - CASE WHEN previous_regime <> regime THEN 0.6 ELSE 0.0 END)
      * 1.0) ** 0.2 AS confidence,
    {CHANGE} AS change_score
  FROM (SELECT *, lag(regime, 5) OVER (PARTITION BY match_id ORDER BY t) AS previous_regime FROM read))"""

PCT = "(round_even(100 * ({}), 0)::BIGINT || '%')"
BECAUSE = f"""concat_ws('|',
    CASE WHEN instability > 0 THEN 'the game shifted at minute ' || t END,
    CASE WHEN greatest(momentum, 1 - momentum) > 0.65 THEN CASE WHEN momentum >= 0.5 THEN 'HOME' ELSE 'AWAY' END
      || ' holds ' || {PCT.format('greatest(momentum, 1 - momentum)')} || ' of the recent pressure' END,
    CASE WHEN recent_shots >= 3 THEN recent_shots || ' shots in 10 minutes' END,
    CASE WHEN home_goals <> away_goals AND t > 75 THEN CASE WHEN home_goals > away_goals THEN 'AWAY' ELSE 'HOME' END
      || ' is behind with little time left' END)"""
