"""Queries: cross-match analytics, story, counterfactuals, lists."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pitchgrid.bindings import state_sql as Q
from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import fixtures, load, match_events, matches
from pitchgrid.operators.nearest import nearest
from pitchgrid.operators.ordered import multiset_digest, top_k
from pitchgrid.plans import matches as M
from pitchgrid.plans import snapshots as S
from pitchgrid.settings import CHECKPOINTS, GOAL_BINS, SHOT_TYPES

EV = ("match_events",)
EM = ("match_events", "matches")
GOALS = """
goals AS (SELECT match_id, event_id, minute, team, sum(CASE WHEN team = 'HOME' THEN 1 ELSE -1 END) OVER w AS diff,
    CASE WHEN team = 'HOME' THEN 1 ELSE -1 END AS delta FROM match_events WHERE type = 'goal' WINDOW w AS (PARTITION BY match_id ORDER BY minute, event_id)),
leads AS (SELECT match_id, greatest(0, max(diff))::BIGINT AS mh, greatest(0, max(-diff))::BIGINT AS ma,
    count(*) FILTER (sign(diff) <> sign(diff - delta) AND diff <> 0) AS ch FROM goals GROUP BY 1),
facts AS (SELECT match_id, count(*) AS n_events, max(minute) AS last_minute, count(*) FILTER (type = 'goal') AS goals,
    count(*) FILTER (type = 'goal' AND team = 'HOME') AS home_goals, count(*) FILTER (type = 'goal' AND team = 'AWAY') AS away_goals,
    count(*) FILTER (type = 'goal' AND minute >= 85) AS goals_from_85, count(*) FILTER (type = 'goal' AND minute >= 80) AS goals_from_80,
    count(*) FILTER (type IN ('shot', 'shot_on_target')) AS shots, count(*) FILTER (type = 'corner') AS corners,
    count(*) FILTER (type IN ('yellow_card', 'red_card')) AS cards, count(*) FILTER (type = 'red_card') AS reds, """ + ", ".join(
    f"count(*) FILTER (type = 'goal' AND minute >= {lo} AND minute < {hi}) AS goals_{lo}_{hi}" for lo, hi in GOAL_BINS) + """,
    coalesce(any_value(mh), 0) AS max_home_lead, coalesce(any_value(ma), 0) AS max_away_lead, coalesce(any_value(ch), 0) AS lead_changes
  FROM match_events LEFT JOIN leads USING (match_id) GROUP BY match_id)"""


def _facts(spark, d):
    return M.match_facts(match_events(spark, d))


@query("w06_lead_swings", GOALS + " SELECT match_id, goals, home_goals, away_goals, max_home_lead, max_away_lead, lead_changes FROM facts", EV)
def w06(spark, d):
    return _facts(spark, d).select("match_id", "goals", "home_goals", "away_goals", "max_home_lead", "max_away_lead", "lead_changes")


@query("w06_p06_goal_sequence", GOALS + " SELECT match_id, event_id, R(minute) AS minute, team, diff::BIGINT AS diff FROM goals", EV)
def w06_goals(spark, d):
    return M.goal_sequence(match_events(spark, d)).select("match_id", "event_id", "minute", "team", "diff")


@query("a33_presets", GOALS + """, hits AS (SELECT *, (max_home_lead >= 2 AND home_goals <= away_goals) AS hl, (max_away_lead >= 2 AND home_goals >= away_goals) AS al FROM facts)
  SELECT match_id, 'comebacks' AS preset, CASE WHEN max_home_lead >= 2 THEN 'AWAY' ELSE 'HOME' END AS stat FROM hits WHERE hl OR al
  UNION ALL SELECT match_id, 'blown_leads', CASE WHEN hl THEN 'HOME +' || max_home_lead ELSE 'AWAY +' || max_away_lead END FROM hits WHERE hl OR al
  UNION ALL SELECT match_id, 'goal_fests', goals::VARCHAR FROM hits WHERE goals >= 5
  UNION ALL SELECT match_id, 'late_drama', goals_from_85::VARCHAR FROM hits WHERE goals_from_85 > 0 AND abs(home_goals - away_goals) <= 1
  UNION ALL SELECT match_id, 'card_storms', cards::VARCHAR FROM hits WHERE cards >= 8""", EV)
def a33(spark, d):
    return M.presets(_facts(spark, d))


@query("a32_quality_issues", GOALS + """ SELECT m.match_id, 'goal events ' || home_goals || '-' || away_goals || ', final ' || home_goals_final || '-' || away_goals_final AS issue
  FROM matches m JOIN facts f USING (match_id) WHERE home_goals <> home_goals_final OR away_goals <> away_goals_final
  UNION ALL SELECT match_id, 'implausible duration' FROM facts WHERE last_minute NOT BETWEEN 30 AND 150""", EM)
def a32(spark, d):
    return M.quality_issues(matches(spark, d), _facts(spark, d))


TEAM = GOALS + """,
sides AS (SELECT match_id, competition, match_date, home_team AS team, 'HOME' AS venue, home_goals AS gf, away_goals AS ga FROM matches JOIN facts USING (match_id)
  UNION ALL SELECT match_id, competition, match_date, away_team, 'AWAY', away_goals, home_goals FROM matches JOIN facts USING (match_id)),
months AS (SELECT team, strftime(match_date, '%Y-%m') AS month, count(*) AS matches, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws,
    count(*) FILTER (gf < ga) AS losses, sum(gf)::BIGINT AS goals_for, sum(ga)::BIGINT AS goals_against FROM sides GROUP BY ALL)"""


def _months(spark, d):
    return M.month_buckets(M.team_matches(matches(spark, d), _facts(spark, d)))


@query("a21_team_months", TEAM + " SELECT * FROM months", EM)
def a21(spark, d):
    return _months(spark, d)


@query("a22_team_evolution", TEAM + """, r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY month) AS rn, count(*) OVER (PARTITION BY team) AS n FROM months),
e AS (SELECT team, coalesce(sum(goals_for - goals_against) FILTER (rn <= greatest(1, n // 3)) / sum(matches) FILTER (rn <= greatest(1, n // 3)), 0) AS early,
    coalesce(sum(goals_for - goals_against) FILTER (rn > n - greatest(1, n // 3)) / sum(matches) FILTER (rn > n - greatest(1, n // 3)), 0) AS late FROM r GROUP BY team)
SELECT team, R(early) AS early, R(late) AS late, CASE WHEN late - early > 0.3 THEN 'improved' WHEN late - early < -0.3 THEN 'declined' ELSE 'stable' END AS verdict FROM e""", EM)
def a22(spark, d):
    return M.evolution_verdict(_months(spark, d))


@query("a23_a24_competition_summary", GOALS + """ SELECT competition, count(*) AS matches, R(avg(goals)) AS goals_per_match, R(avg(duration)) AS avg_minutes,
  R(avg(goals) * 90 / avg(duration)) AS goals_per_90 FROM matches JOIN facts USING (match_id) GROUP BY competition""", EM)
def a24(spark, d):
    return M.competition_summary(matches(spark, d), _facts(spark, d))


@query("a37_outcome_shares", """ SELECT league, count(*) AS n, R(count(*) FILTER (home_goals > away_goals) / count(*)) AS home_win,
  R(count(*) FILTER (home_goals = away_goals) / count(*)) AS draw, R(count(*) FILTER (home_goals < away_goals) / count(*)) AS away_win FROM fixtures GROUP BY league""", ("fixtures",))
def a37(spark, d):
    return M.outcome_shares(fixtures(spark, d), "home_goals", "away_goals", ["league"])


@query("w14_schedule_context", """td AS (SELECT league, team, date, count(*) AS n FROM (SELECT league, home AS team, date FROM fixtures UNION ALL SELECT league, away, date FROM fixtures) GROUP BY ALL)
SELECT league, team, date::VARCHAR AS date, (date - (SELECT max(p.date) FROM td p WHERE p.league = t.league AND p.team = t.team AND p.date < t.date))::DOUBLE AS rest_days,
  coalesce((SELECT sum(p.n) FROM td p WHERE p.league = t.league AND p.team = t.team AND p.date < t.date AND t.date - p.date <= 14), 0)::BIGINT AS congestion FROM td t""", ("fixtures",))
def w14(spark, d):
    fx = fixtures(spark, d)
    sides = fx.select("league", F.explode(F.array("home", "away")).alias("team"), "date")
    return M.schedule_context(sides).withColumn("rest_days", F.col("rest_days").cast("double"))


CP = Q.SNAPSHOT_GRID.replace("grid AS (", "grid0 AS (") + """,
grid AS (SELECT DISTINCT match_id, duration, c AS t FROM grid0, unnest([15, 30, 45, 60, 75, 90]) u(c)),""" + Q.state()
_PIV = ", ".join(f"max(momentum) FILTER (t = {t}) AS momentum_{t}" for t in CHECKPOINTS)
VEC = CP + "," + GOALS + f""",
cps AS (SELECT match_id, {_PIV} FROM read GROUP BY 1),
vecs AS (SELECT match_id, [{', '.join(f'momentum_{t}' for t in CHECKPOINTS)}, {', '.join(f'goals_{lo}_{hi} / 3.0' for lo, hi in GOAL_BINS)},
  least(1, shots / 15.0), least(1, corners / 8.0), least(1, cards / 4.0), least(1, goals / 6.0), least(1, max_home_lead / 3.0), least(1, max_away_lead / 3.0),
  least(1, lead_changes / 3.0), CASE WHEN goals_from_85 > 0 THEN 1.0 ELSE 0.0 END, least(1, reds / 2.0), abs(momentum_90 - 0.5) * 2]::DOUBLE[] AS vec
  FROM facts JOIN cps USING (match_id))"""


@query("f16_match_vectors", VEC + " SELECT match_id, dim::BIGINT AS dim, R(vec[dim + 1]) AS value FROM vecs, unnest(range(0, 22)) u(dim)", EV)
def f16(spark, d):
    return M.match_vectors(match_events(spark, d)).select("match_id", F.posexplode("vec").alias("dim", "value"))


@query("m17_similar_matches", VEC + """,
t AS (SELECT v.* FROM vecs v JOIN matches m USING (match_id) QUALIFY row_number() OVER (PARTITION BY competition ORDER BY match_date DESC, v.match_id) = 1)
SELECT target, candidate, R(s) AS similarity, rank FROM (SELECT t.match_id AS target, v.match_id AS candidate, s, row_number() OVER (PARTITION BY t.match_id ORDER BY round(s, 12) DESC, v.match_id) AS rank
  FROM t, vecs v, LATERAL (SELECT list_cosine_similarity(t.vec, v.vec) AS s) WHERE t.match_id <> v.match_id) WHERE rank <= 5""", EM)
def m17(spark, d):
    v = M.match_vectors(match_events(spark, d)).withColumnRenamed("match_id", "id")
    heads = matches(spark, d).select(F.col("match_id").alias("id"), "competition", "match_date")
    newest = top_k(heads, ["competition"], [F.col("match_date").desc(), F.col("id")], 1).select("id")
    return nearest(v.join(newest, "id", "left_semi"), v, 5)


CHAOS = VEC.replace("vecs AS (", "unused AS (") + """,
ch AS (SELECT match_id, goals, lead_changes, goals_from_80, reds, least(1, 0.25 * least(lead_changes / 2.0, 1) + 0.2 * least(goals_from_80 / 2.0, 1) + 0.15 * least(reds, 1) + 0.2 * least(goals / 6.0, 1)
  + 0.2 * least((abs(momentum_30 - momentum_15) + abs(momentum_45 - momentum_30) + abs(momentum_60 - momentum_45) + abs(momentum_75 - momentum_60) + abs(momentum_90 - momentum_75)) / 5 / 0.25, 1)) AS v
  FROM facts JOIN cps USING (match_id))"""


@query("m18_g01_metric_registry", CHAOS + """ SELECT match_id, 'expected_chaos' AS metric, R(v) AS value, CASE WHEN v >= 0.7 THEN 'wild' WHEN v >= 0.4 THEN 'lively' ELSE 'calm' END || ': ' || goals || ' goals, '
  || lead_changes || ' lead changes, ' || goals_from_80 || ' late, ' || reds || ' red' AS summary FROM ch
  UNION ALL SELECT match_id, 'first_shot', R(min(minute)), 'first shot' FROM match_events WHERE type IN ('shot', 'shot_on_target') GROUP BY match_id""", EV)
def m18(spark, d):
    registry = M.MetricRegistry()
    registry.register("expected_chaos")(M.expected_chaos)
    registry.register_python(
        "first_shot", init=lambda: math.inf, step=lambda first, rows: min([first, *rows.loc[rows["type"].isin(SHOT_TYPES), "minute"]]), merge=min,
        finish=lambda first: (float(first), "first shot"))
    return registry.run(match_events(spark, d))


STORY = Q.PANEL_GRID.replace("range(0, ceil(last_minute)::BIGINT + 1, 1)", "range(0, floor(last_minute)::BIGINT + 1, 5)") + "," + Q.state() + """,
st AS (SELECT match_id, t, home_goals, away_goals, regime, momentum, lag(home_goals) OVER w AS wh, lag(away_goals) OVER w AS wa, lag(regime) OVER w AS wr, lag(momentum) OVER w AS wm
  FROM read WHERE t >= 5 WINDOW w AS (PARTITION BY match_id ORDER BY t)),
beats AS (SELECT match_id, t AS minute,
    CASE WHEN home_goals <> wh OR away_goals <> wa THEN 'goal ' || CASE WHEN home_goals <> wh THEN 'HOME' ELSE 'AWAY' END
      WHEN regime <> wr AND NOT echo THEN 'regime shift' WHEN (wm - 0.5) * (momentum - 0.5) < 0 AND abs(momentum - 0.5) > 0.2 THEN 'momentum swing' END AS headline,
    CASE WHEN home_goals <> wh OR away_goals <> wa THEN home_goals || '-' || away_goals
      WHEN regime <> wr AND NOT echo THEN regime || ' ' || side ELSE side END AS detail
  FROM (SELECT *, CASE WHEN momentum >= 0.5 THEN 'HOME' ELSE 'AWAY' END AS side,
      (SELECT count(*) > 0 FROM match_events e WHERE e.match_id = st.match_id AND e.type = 'goal' AND round_even(e.minute, 0) = st.t) AS echo FROM st) WHERE wr IS NOT NULL),
ends AS (SELECT match_id, max(t) AS minute, max_by(home_goals || '-' || away_goals, t) AS detail FROM st GROUP BY 1)"""


@query("w13_match_story", STORY + """ SELECT match_id, minute, headline, detail FROM beats WHERE headline IS NOT NULL
  UNION ALL SELECT match_id, minute, 'full time', detail FROM ends UNION ALL SELECT match_id, 0, 'kick-off', '' FROM ends""", EV)
def w13(spark, d):
    return M.story(match_events(spark, d))


WHATIF = """
req AS (SELECT match_id, team, min(minute) + 0.25 AS at_minute FROM match_events WHERE type = 'goal' AND team = 'HOME' GROUP BY ALL),
tgt AS (SELECT e.match_id, e.event_id AS removed, floor(e.minute)::BIGINT AS from_minute FROM match_events e JOIN req r ON r.match_id = e.match_id AND r.team = e.team
  WHERE e.type = 'goal' AND abs(e.minute - at_minute) <= 0.6 QUALIFY row_number() OVER (PARTITION BY e.match_id ORDER BY abs(e.minute - at_minute), e.minute, e.event_id) = 1),
worlds AS (SELECT e.match_id || '#b' AS match_id, event_id, minute, team, type FROM match_events e JOIN tgt USING (match_id)
  UNION ALL SELECT e.match_id || '#c', event_id, minute, team, type FROM match_events e JOIN tgt USING (match_id) WHERE event_id <> removed),
grid AS (SELECT match_id || w AS match_id, duration, unnest(range(greatest(1, from_minute), duration + 1)) AS t FROM (
  SELECT t.match_id, from_minute, ceil(max(minute))::BIGINT AS duration FROM match_events e JOIN tgt t USING (match_id) GROUP BY ALL), unnest(['#b', '#c']) u(w)),""" + Q.state(events="worlds") + """,
pair AS (SELECT b.match_id[:-3] AS match_id, b.t AS minute, 1 - exp(-(b.lam_home + b.lam_away) * 10) AS bp, 1 - exp(-(c.lam_home + c.lam_away) * 10) AS cp,
    b.lam_home / (b.lam_home + b.lam_away) AS bn, c.lam_home / (c.lam_home + c.lam_away) AS cn, b.momentum AS bm, c.momentum AS cm,
    b.home_goals AS bh, b.away_goals AS ba, c.home_goals AS ch, c.away_goals AS ca FROM read b JOIN read c ON c.match_id = b.match_id[:-3] || '#c' AND c.t = b.t WHERE b.match_id LIKE '%#b')"""


def _requests(spark, d):
    ev = match_events(spark, d)
    return ev, ev.where("type = 'goal' AND team = 'HOME'").groupBy("match_id", "type", "team").agg((F.min("minute") + 0.25).alias("at"))


@query("j10_nearest_event", WHATIF + " SELECT match_id, removed, from_minute FROM tgt", EV)
def j10(spark, d):
    ev, req = _requests(spark, d)
    return M.find_events(ev, req).select("match_id", F.col("event_id").alias("removed"), F.floor("minute").alias("from_minute"))


@query("w29_what_if_series", WHATIF + """ SELECT match_id, minute, R(bp) AS base_goal_next_10min, R(cp) AS cf_goal_next_10min, R(bn) AS base_next_goal_home, R(cn) AS cf_next_goal_home,
  R(bm) AS base_momentum, R(cm) AS cf_momentum, bh AS base_home_goals, ch AS cf_home_goals FROM pair""", EV)
def w29(spark, d):
    return M.what_if(*_requests(spark, d)).select(
        "match_id", "minute", "base_goal_next_10min", "cf_goal_next_10min", "base_next_goal_home", "cf_next_goal_home", "base_momentum",
        "cf_momentum", "base_home_goals", "cf_home_goals")


@query("w29_what_if_summary", WHATIF + """ SELECT p.match_id, any_value(removed) AS removed, R(max(abs(bp - cp))) AS max_divergence, max_by(bh, minute) AS base_home_goals, max_by(ba, minute) AS base_away_goals,
  max_by(ch, minute) AS cf_home_goals, max_by(ca, minute) AS cf_away_goals, R(max_by(cn - bn, minute)) AS swing FROM pair p JOIN tgt ON tgt.match_id = p.match_id GROUP BY p.match_id""", EV)
def w29_summary(spark, d):
    return M.what_if_summary(M.what_if(*_requests(spark, d)))


@query("p01_catalog", " SELECT match_id, competition, match_date::VARCHAR AS match_date FROM matches WHERE competition = 'C2'", ("matches",))
def p01(spark, d):
    return M.catalog(matches(spark, d), "C2").select("match_id", "competition", "match_date")


@query("p02_k05_team_search", """ SELECT match_id, home_team, away_team, match_date::VARCHAR AS match_date FROM matches
  WHERE contains(lower(home_team), 'am 1') OR contains(lower(away_team), 'am 1') ORDER BY matches.match_date DESC, match_id LIMIT 25""", ("matches",))
def p02(spark, d):
    return M.search_teams(matches(spark, d), "AM 1").select("match_id", "home_team", "away_team", "match_date")


WORDS = ", ".join(
    f"sum(('0x' || substr(md5(row), {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))
DIGEST = f"""
digests AS (SELECT match_id, count(*) AS n_rows, substr(sha256(concat_ws('|', count(*)::VARCHAR, {WORDS})), 1, 16) AS digest
  FROM (SELECT match_id, concat_ws('|', (minute * 1000)::BIGINT::VARCHAR, team, type, player_id) AS row FROM (SELECT *, floor(minute) AS fm FROM match_events)) GROUP BY 1)"""


def _digests(spark, d):
    return multiset_digest(match_events(spark, d), ["match_id"], [F.round(F.col("minute") * 1000).cast("bigint"), F.col("team"), F.col("type"), F.col("player_id")])


@query("s14_event_digest", DIGEST + " SELECT match_id, n_rows, digest FROM digests", EV)
def s14(spark, d):
    return _digests(spark, d)


@query("p06_match_detail", GOALS + "," + DIGEST + """ SELECT m.match_id, n_events, R(last_minute) AS last_minute, goals, digest FROM matches m JOIN facts USING (match_id) JOIN digests USING (match_id)""", EM)
def p06(spark, d):
    return M.match_detail(matches(spark, d), _facts(spark, d), _digests(spark, d)).select("match_id", "n_events", "last_minute", "goals", "digest")


@query("p07_j03_named_events", """ SELECT event_id, match_id, e.player_id, s_name AS name FROM match_events e LEFT JOIN supplier ON 'p' || s_suppkey = e.player_id AND s_suppkey % 3 = 0""", EV)
def p07(spark, d):
    names = load(spark, d, "supplier").where(F.pmod("s_suppkey", F.lit(3)) == 0).select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("player_id"), F.col("s_name").alias("name"))
    return M.named_events(match_events(spark, d), names).select("event_id", "match_id", "player_id", "name")


@query("p08_removable_events", " SELECT event_id, match_id, type FROM match_events WHERE type IN ('goal', 'red_card', 'yellow_card')", EV)
def p08(spark, d):
    from pitchgrid.settings import REMOVABLE_TYPES
    return match_events(spark, d).where(F.col("type").isin(*REMOVABLE_TYPES)).select("event_id", "match_id", "type")


@query("p09_real_duration", " SELECT match_id, R(coalesce(max(minute) FILTER (type <> 'foul') , max(minute))) AS minutes FROM match_events GROUP BY 1", EV)
def p09(spark, d):
    ev = match_events(spark, d)
    return M.real_duration(ev, ev.where("type <> 'foul'").select("match_id", (F.col("minute") * 60.0).alias("t")))


@query("w30_memory_replay", " SELECT match_id, event_id, R(minute) AS minute, type AS headline FROM match_events WHERE type IN ('goal', 'red_card')", EV)
def w30(spark, d):
    ev = match_events(spark, d).select("match_id", "event_id", "minute", F.col("type").alias("headline"))
    return M.replay(M.remember(ev.where("headline = 'goal'"), ev.where("headline = 'red_card'")))


@query("w27_live_clock", " SELECT match_id, event_id, R(max(minute) OVER (PARTITION BY match_id ORDER BY seq)) AS clock FROM (SELECT *, (event_id // 100) * 100 + (event_id * 37 % 100) AS seq FROM match_events)", EV)
def w27(spark, d):
    from pitchgrid.operators.ordered import running_max
    ev = match_events(spark, d).withColumn("seq", F.expr("cast(floor(event_id / 100) as bigint)") * 100 + F.pmod(F.col("event_id") * 37, F.lit(100)))
    return running_max(ev, ["match_id"], F.floor(F.col("seq") / 1000), [F.col("seq")], "minute", "clock").select("match_id", "event_id", "clock")


@query("j04_j05_semi_anti", """ SELECT match_id, 'has reds' AS bucket FROM matches WHERE match_id IN (SELECT match_id FROM match_events WHERE type = 'red_card')
  UNION ALL SELECT match_id, 'no reds' FROM matches WHERE match_id NOT IN (SELECT match_id FROM match_events WHERE type = 'red_card')""", EM)
def j04(spark, d):
    m, reds = matches(spark, d).select("match_id"), match_events(spark, d).where("type = 'red_card'").select("match_id")
    return m.join(reds, "match_id", "left_semi").withColumn("bucket", F.lit("has reds")).unionByName(
        m.join(reds, "match_id", "left_anti").withColumn("bucket", F.lit("no reds")))
