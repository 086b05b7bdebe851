"""Queries: projection, ratings, tactics, tracking, narrative."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings import state_sql as Q
from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import fixtures, load, match_events, matches
from pitchgrid.functions import clock as K
from pitchgrid.functions.scoring import implied_probabilities, outcome_index
from pitchgrid.functions.text import direction_of
from pitchgrid.plans import matches as M
from pitchgrid.plans import narrative as N
from pitchgrid.plans import projection as P
from pitchgrid.plans import ratings as R
from pitchgrid.plans import tactics as T
from pitchgrid.plans import tracking as V
from pitchgrid.settings import NEGATIVE_WORDS, POSITIVE_WORDS

EV = ("match_events",)
EM = ("match_events", "matches")
FX = ("fixtures",)
GRID5 = Q.PANEL_GRID.replace("range(0, ceil(last_minute)::BIGINT + 1, 1)", "range(0, ceil(last_minute)::BIGINT + 1, 5)")
LANE_OF = "CASE WHEN y >= 66.667 THEN 'left' WHEN y < 33.333 THEN 'right' ELSE 'central' END"
STATES = GRID5 + "," + Q.state() + f""",
lw AS (SELECT r.match_id, r.t, s.team, l.lane, coalesce(sum(exp((e.minute - r.t) / 8.0::DOUBLE)) FILTER ({LANE_OF} = l.lane), 0) AS w
  FROM read r CROSS JOIN (VALUES ('HOME'), ('AWAY')) s(team) CROSS JOIN (VALUES ('left'), ('central'), ('right')) l(lane)
  LEFT JOIN match_events e ON e.match_id = r.match_id AND e.team = s.team AND e.minute <= r.t AND e.type IN ('shot', 'shot_on_target', 'goal', 'corner') AND e.y IS NOT NULL GROUP BY ALL),
shares AS (SELECT match_id, t, team, lane, CASE WHEN sum(w) OVER v = 0 THEN 1.0 / 3 ELSE w / sum(w) OVER v END AS share FROM lw WINDOW v AS (PARTITION BY match_id, t, team)),
sl AS (SELECT *, greatest(0, duration - t) AS horizon, CASE WHEN duration > t THEN greatest(1, ceil((duration - t) / 0.25))::INTEGER ELSE 0 END AS n,
    least(1, lam_home * 0.25) AS p_home, least(1, lam_away * 0.25) AS p_away FROM read)"""


def pmf(n, p, k):
    return (f"CASE WHEN {k} > {n} THEN 0 ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p})) END")


def outcomes(src: str, name: str, keys: str) -> str:
    """Score grid summed over all goal counts of both sides, 0 to the number of slices."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    return f"""
{name}h AS (SELECT {keys}, home_goals - away_goals AS lead, n AS most, k, {pmf('n', 'p_home', 'k')} AS p FROM {src}, unnest(range(0, n + 1)) u(k)),
{name}a AS (SELECT {keys}, k, p, sum(p) OVER (PARTITION BY {keys} ORDER BY k) AS upto FROM (SELECT {keys}, k, {pmf('n', 'p_away', 'k')} AS p FROM {src}, unnest(range(0, n + 1)) u(k))),
{name} AS (SELECT {', '.join(f'h.{k}' for k in keys.split(', '))}, sum(h.p * coalesce(f.upto, 0)) AS hw, sum(h.p * coalesce(d.p, 0)) AS dr
  FROM {name}h h LEFT JOIN {name}a d ON {same('h', 'd')} AND d.k = h.lead + h.k LEFT JOIN {name}a f ON {same('h', 'f')} AND f.k = least(h.lead + h.k - 1, h.most) GROUP BY ALL)"""


OUT = STATES + "," + outcomes("sl", "oc", "match_id, t")


def _sliced(spark, d):
    return P.with_slices(P.lane_states(match_events(spark, d)))


@query("m11_outcome_projection", OUT + """ SELECT s.match_id, s.t AS minute, R(horizon) AS horizon, R(coalesce(hw, 0)) AS home_win, R(coalesce(dr, 0)) AS draw, R(1 - coalesce(hw, 0) - coalesce(dr, 0)) AS away_win,
  R(n * p_home) AS expected_home, R(n * p_away) AS expected_away, R(1 - (1 - p_home) ** n) AS goal_home, R(1 - (1 - p_away) ** n) AS goal_away,
  R(1 - ((1 - p_home) * (1 - p_away)) ** n) AS goal_any FROM sl s JOIN oc USING (match_id, t)""", EV)
def m11(spark, d):
    return P.project(_sliced(spark, d)).select("match_id", F.col("t").alias("minute"), "horizon", "home_win", "draw", "away_win",
                                               "expected_home", "expected_away", "goal_home", "goal_away", "goal_any")


@query("w10_lane_weights", STATES + " SELECT match_id, t AS minute, team, lane, R(share) AS share FROM shares", EV)
def w10(spark, d):
    s = P.lane_states(match_events(spark, d))
    return s.select("match_id", F.col("t").alias("minute"), F.explode(F.array(*[
        F.struct(F.lit(t.upper()).alias("team"), F.lit(n).alias("lane"), F.col(f"share_{t}_{n}").alias("share"))
        for t in ("home", "away") for n in ("left", "central", "right")])).alias("x")).select("match_id", "minute", "x.*")


@query("k03_top_scorelines", OUT + """, th AS (SELECT * FROM och QUALIFY row_number() OVER (PARTITION BY match_id, t ORDER BY p DESC, k) <= 6),
ta AS (SELECT * FROM oca QUALIFY row_number() OVER (PARTITION BY match_id, t ORDER BY p DESC, k) <= 6)
SELECT match_id, minute, rank, home, away, R(p) AS prob FROM (SELECT h.match_id, h.t AS minute, h.k::BIGINT AS home, a.k::BIGINT AS away, h.p * a.p AS p,
  row_number() OVER (PARTITION BY h.match_id, h.t ORDER BY h.p * a.p DESC, h.k, a.k) AS rank FROM th h JOIN ta a USING (match_id, t) WHERE most > 0) WHERE rank <= 6""", EV)
def k03(spark, d):
    return P.scorelines(_sliced(spark, d))


@query("k04_lane_windows", STATES + """ SELECT match_id, minute, row_number() OVER (PARTITION BY match_id, minute ORDER BY round(p, 9) DESC, eta, team, lane) AS rank, team, lane,
  R(p) AS probability, R(eta) AS eta_seconds, R(15) AS window_seconds FROM (
  SELECT match_id, t AS minute, team, lane, p, greatest(0, ceil(ln(1 - p / 2) / ln(1 - q)) - 1) * 15 AS eta FROM (
  SELECT s.match_id, s.t, team, lane, q, 1 - (1 - q) ** n AS p FROM (SELECT sl.match_id, sl.t, n, team, lane, share * CASE team WHEN 'HOME' THEN p_home ELSE p_away END AS q
    FROM sl JOIN shares USING (match_id, t) WHERE n > 0) s) WHERE p >= 0.05)""", EV)
def k04(spark, d):
    return P.lane_windows(_sliced(spark, d))


APP = STATES + """,
app AS (SELECT match_id, t, approach, home_goals, away_goals, n, least(1, lam_home * o * 0.25) AS p_home, least(1, lam_away * x * 0.25) AS p_away
  FROM sl, (VALUES ('keep', 1.0, 1.0), ('attack', 1.35, 1.18), ('defend', 0.72, 0.6), ('control', 0.9, 0.8)) v(approach, o, x)),""" + outcomes("app", "ap", "match_id, t, approach")


@query("m14_j15_decisions", APP + """, d AS (SELECT match_id, t, approach, coalesce(hw, 0) AS win, coalesce(dr, 0) AS draw FROM ap),
b AS (SELECT match_id, t, max(win) FILTER (approach = 'keep') AS keep_win, max_by(approach, round(win, 9)::VARCHAR || approach) AS top, max(win) AS top_win FROM d GROUP BY ALL)
SELECT match_id, t AS minute, approach, R(win) AS win, R(draw) AS draw, R(1 - win - draw) AS loss, R(win - keep_win) AS delta_win,
  CASE WHEN top_win - keep_win > 0.005 THEN (SELECT arg_max(approach, win) FROM d x WHERE x.match_id = b.match_id AND x.t = b.t) ELSE 'keep' END AS recommended FROM d JOIN b USING (match_id, t)""", EV)
def m14(spark, d):
    return P.rank_decisions(P.lane_states(match_events(spark, d)), "HOME")


@query("m14_decisions_away", APP.replace("lam_home * o", "lam_home * x_").replace("lam_away * x *", "lam_away * o *").replace("lam_home * x_", "lam_home * x") + """,
d AS (SELECT match_id, t, approach, 1 - coalesce(hw, 0) - coalesce(dr, 0) AS win, coalesce(dr, 0) AS draw FROM ap),
b AS (SELECT match_id, t, max(win) FILTER (approach = 'keep') AS keep_win, max(win) AS top_win FROM d GROUP BY ALL)
SELECT match_id, t AS minute, approach, R(win) AS win, R(draw) AS draw, R(1 - win - draw) AS loss, R(win - keep_win) AS delta_win,
  CASE WHEN top_win - keep_win > 0.005 THEN (SELECT arg_max(approach, win) FROM d x WHERE x.match_id = b.match_id AND x.t = b.t) ELSE 'keep' END AS recommended FROM d JOIN b USING (match_id, t)""", EV)
def m14_away(spark, d):
    return P.rank_decisions(P.lane_states(match_events(spark, d)), "AWAY")


@query("m13_checkpoint_accuracy", OUT + """,
truth AS (SELECT match_id, CASE WHEN home_goals_final > away_goals_final THEN 0 WHEN home_goals_final = away_goals_final THEN 1 ELSE 2 END AS y FROM matches),
sh AS (SELECT avg((y = 0)::INT) AS c0, avg((y = 1)::INT) AS c1, avg((y = 2)::INT) AS c2 FROM truth),
j AS (SELECT t, y, hw AS a, dr AS b, 1 - hw - dr AS c, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS stay, c0, c1, c2
  FROM (SELECT match_id, t, coalesce(hw, 0) AS hw, coalesce(dr, 0) AS dr FROM oc) JOIN sl USING (match_id, t) JOIN truth USING (match_id), sh WHERE t IN (0, 15, 30, 45, 60, 75, 85) AND t < duration)
SELECT t AS minute, count(*) AS n, R(avg((CASE WHEN round(a, 9) >= round(b, 9) AND round(a, 9) >= round(c, 9) THEN 0 WHEN round(b, 9) >= round(c, 9) THEN 1 ELSE 2 END = y)::INT)) AS accuracy,
  R(avg((a - (y = 0)::INT) ** 2 + (b - (y = 1)::INT) ** 2 + (c - (y = 2)::INT) ** 2)) AS brier, R(avg((stay = y)::INT)) AS persist_accuracy,
  R(avg(CASE WHEN stay = y THEN 0 ELSE 2 END)) AS persist_brier, R(avg((c0 - (y = 0)::INT) ** 2 + (c1 - (y = 1)::INT) ** 2 + (c2 - (y = 2)::INT) ** 2)) AS constant_brier,
  R(avg(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END)) AS p_true FROM j GROUP BY t""", EM)
def m13(spark, d):
    m = matches(spark, d)
    truth = m.select("match_id", outcome_index(F.col("home_goals_final"), F.col("away_goals_final")).alias("actual"))
    shares = M.outcome_shares(m, "home_goals_final", "away_goals_final", []).drop("n")
    states = _sliced(spark, d).where(F.col("t").isin(0, 15, 30, 45, 60, 75, 85) & (F.col("t") < F.col("duration")))
    return P.checkpoint_accuracy(P.project(states), truth, shares)


# ratings ------------------------------------------------------------------- #
NAIVE = """
naive AS (SELECT *, (count(*) OVER w)::BIGINT AS before, 1 + count(*) OVER w AS match_no, (1 + coalesce(sum((y = 0)::INT) OVER w, 0)) / (3 + count(*) OVER w) AS naive_h,
    (1 + coalesce(sum((y = 1)::INT) OVER w, 0)) / (3 + count(*) OVER w) AS naive_d, (1 + coalesce(sum((y = 2)::INT) OVER w, 0)) / (3 + count(*) OVER w) AS naive_a
  FROM (SELECT *, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS y FROM fixtures)
  WINDOW w AS (PARTITION BY league, season ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("w24_trailing_frequencies", NAIVE + " SELECT seq, match_no, R(naive_h) AS naive_h, R(naive_d) AS naive_d, R(naive_a) AS naive_a FROM naive", FX)
def w24(spark, d):
    return R.trailing_frequencies(fixtures(spark, d)).select("seq", "match_no", "naive_h", "naive_d", "naive_a")


POISSON = """
forms AS (SELECT seq, side, coalesce(sum(gf) OVER w, 0) AS sc, coalesce(sum(ga) OVER w, 0) AS co, count(*) OVER w AS pl FROM (
    SELECT league, season, seq, date, 'h' AS side, home AS team, home_goals AS gf, away_goals AS ga FROM fixtures UNION ALL SELECT league, season, seq, date, 'a', away, away_goals, home_goals FROM fixtures)
  WINDOW w AS (PARTITION BY league, season, team ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lg AS (SELECT seq, CASE WHEN count(*) OVER w = 0 THEN 1.45 ELSE avg(home_goals) OVER w END AS ha, CASE WHEN count(*) OVER w = 0 THEN 1.15 ELSE avg(away_goals) OVER w END AS aa
  FROM fixtures WINDOW w AS (PARTITION BY league, season ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT lg.seq, ha, aa, (ha + aa) / 2 AS ov, h.sc AS hs, h.co AS hc, h.pl AS hp, a.sc AS as_, a.co AS ac, a.pl AS ap FROM lg JOIN forms h ON h.seq = lg.seq AND h.side = 'h' JOIN forms a ON a.seq = lg.seq AND a.side = 'a'),
lam AS (SELECT seq, ha * CASE WHEN ov <= 0 THEN 1 ELSE (hs / greatest(1, hp) / ov * hp + 6) / (hp + 6) END * CASE WHEN ov <= 0 THEN 1 ELSE (ac / greatest(1, ap) / ov * ap + 6) / (ap + 6) END AS lh,
    aa * CASE WHEN ov <= 0 THEN 1 ELSE (as_ / greatest(1, ap) / ov * ap + 6) / (ap + 6) END * CASE WHEN ov <= 0 THEN 1 ELSE (hc / greatest(1, hp) / ov * hp + 6) / (hp + 6) END AS la FROM st),
pois AS (SELECT seq, any_value(lh) AS lam_home, any_value(la) AS lam_away, sum(p) FILTER (i > j) / sum(p) AS poisson_h, sum(p) FILTER (i = j) / sum(p) AS poisson_d, sum(p) FILTER (i < j) / sum(p) AS poisson_a
  FROM (SELECT seq, lh, la, i, j, exp(-lh) * lh ** i / factorial(i) * exp(-la) * la ** j / factorial(j) AS p FROM lam, (SELECT unnest(range(0, 11))::INTEGER AS i), (SELECT unnest(range(0, 11))::INTEGER AS j)) GROUP BY seq)"""


@query("w25_attack_defence", POISSON + """ SELECT seq, R(lam_home) AS lam_home, R(lam_away) AS lam_away, R(coalesce(poisson_h, 0)) AS poisson_h, R(poisson_d) AS poisson_d,
  R(coalesce(poisson_a, 0)) AS poisson_a FROM pois""", FX)
def w25(spark, d):
    return R.attack_defence(fixtures(spark, d)).drop(*R.LEAGUE)


_E = "1 / (1 + 10::DOUBLE ** (-(r[hi] + 60 - r[ai]) / 400))"
ELO = f"""
ord AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY date, seq) AS rn, substr(home, 2)::BIGINT + 1 AS hi, substr(away, 2)::BIGINT + 1 AS ai,
    CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END::DOUBLE AS s FROM fixtures),
walk AS (SELECT DISTINCT league, season, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::DOUBLE AS e, [{', '.join(['1500.0::DOUBLE'] * 12)}] AS r FROM fixtures
  UNION ALL SELECT w.league, w.season, o.rn, o.seq, {_E}, list_transform(r, lambda v, i: v + CASE WHEN i = hi THEN 20 * (s - {_E}) WHEN i = ai THEN -20 * (s - {_E}) ELSE 0 END)
  FROM walk w JOIN ord o ON o.league = w.league AND o.season = w.season AND o.rn = w.rn + 1)"""


@query("w26_elo", ELO + " SELECT seq, R(e) AS expected_home FROM walk WHERE seq IS NOT NULL", FX)
def w26(spark, d):
    return R.elo(fixtures(spark, d)).drop(*R.LEAGUE)


@query("m10_ratings_benchmark", NAIVE + "," + POISSON + "," + ELO + """,
pred AS (SELECT n.y, naive_h, naive_d, naive_a, e * (1 - naive_d) AS elo_h, naive_d AS elo_d, (1 - e) * (1 - naive_d) AS elo_a, coalesce(poisson_h, 0) AS ph, poisson_d AS pd, coalesce(poisson_a, 0) AS pa,
    1 / odds_h / (1 / odds_h + 1 / odds_d + 1 / odds_a) AS oh, 1 / odds_d / (1 / odds_h + 1 / odds_d + 1 / odds_a) AS od, 1 / odds_a / (1 / odds_h + 1 / odds_d + 1 / odds_a) AS oa
  FROM naive n JOIN pois USING (seq) JOIN (SELECT seq, e FROM walk WHERE seq IS NOT NULL) USING (seq) WHERE match_no > 30),
long AS (SELECT 'naive' AS model, y, naive_h AS h, naive_d AS d, naive_a AS a FROM pred UNION ALL SELECT 'elo', y, elo_h, elo_d, elo_a FROM pred
  UNION ALL SELECT 'poisson', y, ph, pd, pa FROM pred UNION ALL SELECT 'odds', y, oh, od, oa FROM pred)
SELECT model, count(*) AS n, R(avg((h - (y = 0)::INT) ** 2 + (d - (y = 1)::INT) ** 2 + (a - (y = 2)::INT) ** 2)) AS brier,
  R(avg(-ln(greatest(1e-15, CASE y WHEN 0 THEN h WHEN 1 THEN d ELSE a END)))) AS log_loss FROM long GROUP BY model""", FX)
def m10(spark, d):
    return R.benchmark(R.predictions(fixtures(spark, d)), burn_in=30)


@query("f13_implied_odds", """ SELECT seq, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END::BIGINT AS outcome,
  R(1 / odds_h / (1 / odds_h + 1 / odds_d + 1 / odds_a)) AS p_home, R(1 / odds_d / (1 / odds_h + 1 / odds_d + 1 / odds_a)) AS p_draw FROM fixtures""", FX)
def f13(spark, d):
    p = implied_probabilities([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])
    return fixtures(spark, d).select("seq", outcome_index(F.col("home_goals"), F.col("away_goals")).alias("outcome"), p[0].alias("p_home"), p[1].alias("p_draw"))


# tactics ------------------------------------------------------------------- #
_side = "count(*) FILTER (team = '{S}') AS n_{s}, coalesce(sum(w * x) FILTER (team = '{S}') / sum(w) FILTER (team = '{S}'), 50) AS block_{s}, " + ", ".join(
    f"coalesce(sum(w) FILTER (team = '{{S}}' AND atk AND lane = '{n}'), 0) AS {n}_{{s}}" for n in ("left", "central", "right"))
GEO = GRID5 + "," + Q.state(tau="10.0") + f""",
near AS (SELECT g.match_id, g.t, e.team, e.x, exp((e.minute - g.t) / 10.0::DOUBLE) AS w, e.type IN ('shot', 'shot_on_target', 'goal', 'corner') AS atk, {LANE_OF} AS lane
  FROM grid g JOIN match_events e ON e.match_id = g.match_id AND e.minute <= g.t AND e.minute >= g.t - 15 AND e.x IS NOT NULL),
agg AS (SELECT match_id, t, {_side.format(S='HOME', s='home')}, {_side.format(S='AWAY', s='away')} FROM near GROUP BY ALL),
geo AS (SELECT match_id, t, momentum AS terr, coalesce(n_home, 0) AS n_home, coalesce(n_away, 0) AS n_away, coalesce(block_home, 50) AS block_home, coalesce(block_away, 50) AS block_away, """ + ", ".join(
    f"CASE WHEN coalesce(left_{s} + central_{s} + right_{s}, 0) > 1e-12 THEN {n}_{s} / (left_{s} + central_{s} + right_{s}) ELSE 1.0 / 3 END AS sh_{n}_{s}" for s in ("home", "away") for n in ("left", "central", "right")) + """
  FROM read LEFT JOIN agg USING (match_id, t)),
pick AS (SELECT *, CASE WHEN terr >= 0.5 THEN 'HOME' ELSE 'AWAY' END AS tt, CASE WHEN terr >= 0.5 THEN sh_left_home ELSE sh_left_away END AS l, CASE WHEN terr >= 0.5 THEN sh_central_home ELSE sh_central_away END AS c,
  CASE WHEN terr >= 0.5 THEN sh_right_home ELSE sh_right_away END AS r FROM geo)"""


@query("w09_tactical_geometry", GEO + """ SELECT match_id, t AS minute, R(terr) AS territory_home, n_home AS actions_home, n_away AS actions_away, R(block_home) AS block_home, R(block_away) AS block_away,
  R(sh_left_home) AS share_left_home, R(sh_right_away) AS share_right_away, tt AS top_team, CASE WHEN abs(l - greatest(l, c, r)) < 1e-9 THEN 'left' WHEN abs(c - greatest(l, c, r)) < 1e-9 THEN 'central' ELSE 'right' END AS top_lane,
  R(greatest(l, c, r)) AS top_share FROM pick""", EV)
def w09(spark, d):
    return T.geometry(match_events(spark, d)).select("match_id", "minute", "territory_home", "actions_home", "actions_away", "block_home", "block_away",
                                                     "share_left_home", "share_right_away", "top_team", "top_lane", "top_share")


THIRDS = """th AS (SELECT match_id, team, count(x) AS n, count(*) FILTER (x < 100.0 / 3) / count(x) AS own, count(*) FILTER (x BETWEEN 100.0 / 3 AND 200.0 / 3) / count(x) AS mid,
  count(*) FILTER (x > 200.0 / 3) / count(x) AS att FROM match_events GROUP BY ALL)"""


@query("a27_thirds_distribution", THIRDS + " SELECT match_id, team, R(own) AS own, R(mid) AS mid, R(att) AS att FROM th", EV)
def a27(spark, d):
    return T.thirds(match_events(spark, d))


@query("w11_w12_tactics", THIRDS + """, nx AS (SELECT match_id, team, x, minute, lead(x) OVER w AS nx, lead(minute) OVER w AS nm FROM match_events WINDOW w AS (PARTITION BY match_id, team ORDER BY minute, event_id)),
ct AS (SELECT match_id, team, count(*) AS counters FROM nx WHERE x < 100.0 / 3 AND nx > 200.0 / 3 AND nm - minute <= 10.0 / 60 GROUP BY ALL)
SELECT match_id, team, coalesce(counters, 0) AS counters, CASE WHEN coalesce(counters, 0) > 0 THEN 'counter_attack' WHEN own > 0.5 THEN 'low_block' WHEN att > 0.5 THEN 'high_press' ELSE 'mid_block' END AS tactic
FROM th LEFT JOIN ct USING (match_id, team)""", EV)
def w11(spark, d):
    return T.tactic_labels(match_events(spark, d)).select("match_id", "team", "counters", "tactic")


@query("f22_pitch_geometry", f""" SELECT event_id, {LANE_OF} AS lane, R(100 - x) AS mirrored_x, CASE WHEN x < 100.0 / 3 THEN 'own' WHEN x > 200.0 / 3 THEN 'att' ELSE 'mid' END AS third,
  R(x * 1.2 * 100 / 120) AS rescaled_x, R(y * 0.8 * 100 / 80) AS rescaled_y FROM match_events""", EV)
def f22(spark, d):
    x, y = F.col("x"), F.col("y")
    return match_events(spark, d).select("event_id", K.lane(y).alias("lane"), K.toward_right(x, False).alias("mirrored_x"), K.third(x).alias("third"),
                                         K.rescale_x(x * 1.2).alias("rescaled_x"), K.rescale_y(y * 0.8).alias("rescaled_y"))


# tracking ------------------------------------------------------------------ #
def _observations(spark, d):
    ev = match_events(spark, d)
    return ev.select(F.concat_ws("-", "match_id", "team").alias("entity"), (F.floor(F.col("minute") * 6) * 10.0).alias("t"), F.col("event_id").alias("seq"), "x", "y",
                     F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("type")).alias("name"))


OBS = """
obs AS (SELECT match_id || '-' || team AS entity, floor(minute * 6) * 10.0::DOUBLE AS t, event_id AS seq, x, y, CASE WHEN event_id % 5 <> 0 THEN type END AS name FROM match_events),
lg AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM obs WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
v0 AS (SELECT *, CASE WHEN pt IS NULL THEN 0 WHEN t > pt THEN (x - px) / (t - pt) END AS rx, CASE WHEN pt IS NULL THEN 0 WHEN t > pt THEN (y - py) / (t - pt) END AS ry FROM lg),
v1 AS (SELECT *, rx * CASE WHEN sqrt(rx * rx + ry * ry) > 11 THEN 11 / sqrt(rx * rx + ry * ry) ELSE 1 END AS cx, ry * CASE WHEN sqrt(rx * rx + ry * ry) > 11 THEN 11 / sqrt(rx * rx + ry * ry) ELSE 1 END AS cy FROM v0),
v AS (SELECT *, last_value(cx IGNORE NULLS) OVER w AS vx, last_value(cy IGNORE NULLS) OVER w AS vy FROM v1 WINDOW w AS (PARTITION BY entity ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
TIMES = [900.0, 2700.0, 4000.0, 5400.0]


def _est(name, use_velocity, xy, vxy):
    sql = OBS + f""" SELECT entity, at_t AS instant, name, {xy}, {vxy}, R(CASE WHEN age <= 0 THEN 1 ELSE 0.5 ** (age / 20) END) AS confidence, R(age) AS age, (age < 0.05)::BIGINT AS observed FROM (
      SELECT entity, at_t, at_t - max(t) AS age, arg_max(x, (t, seq)) AS x, arg_max(y, (t, seq)) AS y, arg_max(vx, (t, seq)) AS vx, arg_max(vy, (t, seq)) AS vy,
        arg_max(name, (t, seq)) FILTER (name IS NOT NULL) AS name FROM v, (VALUES (900.0::DOUBLE), (2700.0::DOUBLE), (4000.0::DOUBLE), (5400.0::DOUBLE)) a(at_t) WHERE t <= at_t GROUP BY entity, at_t) WHERE age <= 120"""
    query(name, sql, EV)(lambda spark, d: V.estimate(_observations(spark, d), TIMES, use_velocity=use_velocity).withColumnRenamed("at", "instant"))


_est("w18_position_estimates", False, "R(x) AS x, R(y) AS y", "R(vx) AS vx, R(vy) AS vy")
_K = "CASE WHEN age > 0 THEN (0.82::DOUBLE ** age - 1) / ln(0.82::DOUBLE) ELSE 0 END"
_est("w18_position_estimates_moving", True, f"R(least(100, greatest(0, x + vx * {_K}))) AS x, R(least(100, greatest(0, y + vy * {_K}))) AS y",
     "R(vx * 0.82::DOUBLE ** age) AS vx, R(vy * 0.82::DOUBLE ** age) AS vy")

ERR = OBS + """,
e0 AS (SELECT *, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy, count(*) OVER (PARTITION BY entity) AS n FROM v WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
e AS (SELECT entity, t, seq, t - pt AS gap, sqrt((x - px) ** 2 + (y - py) ** 2) AS se, CASE WHEN t > pt THEN sqrt((x - least(100, greatest(0, px + pvx * (0.82::DOUBLE ** (t - pt) - 1) / ln(0.82::DOUBLE)))) ** 2
  + (y - least(100, greatest(0, py + pvy * (0.82::DOUBLE ** (t - pt) - 1) / ln(0.82::DOUBLE)))) ** 2) ELSE sqrt((x - px) ** 2 + (y - py) ** 2) END AS err FROM e0 WHERE pt IS NOT NULL AND n >= 4)"""


@query("w19_prediction_errors", ERR + " SELECT entity, t, seq, R(err) AS error, R(se) AS static_error, gap FROM e", EV)
def w19(spark, d):
    return V.prediction_errors(_observations(spark, d))


@query("w19_self_evaluation", ERR + """ SELECT count(*) AS n, R(avg(err)) AS mean_error, R(list_sort(list(err))[floor(count(*) / 2)::BIGINT + 1]) AS median_error, R(list_sort(list(err))[floor(count(*) * 0.9)::BIGINT + 1]) AS p90_error,
  R(avg(se)) AS static_mean, R(avg(se) - avg(err)) AS beats_static_by, R(avg(gap)) AS mean_gap FROM e""", EV)
def w19_eval(spark, d):
    return V.evaluation(V.prediction_errors(_observations(spark, d)))


# narrative ----------------------------------------------------------------- #
_NEG, _POS = "|".join(NEGATIVE_WORDS), "|".join(POSITIVE_WORDS)
DIR = f"""dirs AS (SELECT *, CASE WHEN regexp_matches(lower(text), '{_NEG}') THEN 'worse' WHEN regexp_matches(lower(text), '{_POS}') THEN 'better' ELSE 'same' END AS direction FROM documents),
ref AS (SELECT lang, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY lang),
lab AS (SELECT doc_id, source, direction, z, CASE WHEN direction = 'same' THEN CASE WHEN abs(z) <= 0.5 THEN 'Confirmed' WHEN abs(z) > 1.5 THEN 'Strongly contradicted' ELSE 'Not confirmed' END
    WHEN sign(z) = d AND abs(z) > 1.5 THEN 'Confirmed' WHEN sign(z) = d AND abs(z) > 0.5 THEN 'Partially confirmed' WHEN sign(z) <> d AND abs(z) > 1.5 THEN 'Strongly contradicted' ELSE 'Not confirmed' END AS label
  FROM (SELECT doc_id, source, direction, (n_chars - m) / s AS z, CASE direction WHEN 'better' THEN 1 ELSE -1 END AS d FROM dirs JOIN ref USING (lang)))"""


def _labelled(spark, d):
    docs = load(spark, d, "documents").withColumn("direction", direction_of(F.col("text"))).select("doc_id", "lang", "source", "n_chars", "direction")
    ref = docs.groupBy("lang").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return docs.join(ref, "lang").withColumn("label", N.verify(F.col("direction"), F.col("n_chars").cast("double"), F.col("m"), F.col("s")))


NARR = "WITH " + DIR


@query("f04_opinion_direction", NARR + " SELECT doc_id, direction FROM dirs")
def f04(spark, d):
    return load(spark, d, "documents").select("doc_id", direction_of(F.col("text")).alias("direction"))


@query("f11_verdicts", NARR + " SELECT doc_id, source, direction, label FROM lab")
def f11(spark, d):
    return _labelled(spark, d).select("doc_id", "source", "direction", "label")


@query("a34_credibility", NARR + """ SELECT source, count(*) FILTER (label IN ('Confirmed', 'Partially confirmed')) AS hits, count(*) AS total,
  R(avg((label IN ('Confirmed', 'Partially confirmed'))::INT)) AS weight FROM lab GROUP BY source""")
def a34(spark, d):
    return N.credibility(_labelled(spark, d), "source")


@query("a34_running_credibility", NARR + """ SELECT doc_id, source, (sum((label IN ('Confirmed', 'Partially confirmed'))::INT) OVER w)::BIGINT AS hits, count(*) OVER w AS total,
  R(avg((label IN ('Confirmed', 'Partially confirmed'))::INT) OVER w) AS weight FROM lab WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def a34_running(spark, d):
    return N.running_credibility(_labelled(spark, d), "source", "doc_id", F.floor(F.col("doc_id") / 1000)).select("doc_id", "source", "hits", "total", "weight")


@query("f12_collective_state", """ SELECT seq, R(abs(cents % 101 - (cents // 101) % 101)) AS divergence, (abs(cents % 101 - (cents // 101) % 101) > 40)::BIGINT AS overreaction FROM fixtures""", FX)
def f12(spark, d):
    e, r = F.pmod("cents", F.lit(101)).cast("double"), F.pmod(F.floor(F.col("cents") / 101), F.lit(101)).cast("double")
    return fixtures(spark, d).select("seq", *N.collective_state(e, r))


@query("a36_coach_profiles", """, co AS (SELECT league || home AS coach, CASE WHEN home_goals > away_goals THEN 'winning' WHEN home_goals < away_goals THEN 'losing' ELSE 'drawing' END AS ctx, home_goals + away_goals AS g FROM fixtures),
p AS (SELECT coach, avg(g) FILTER (ctx = 'winning') AS w, avg(g) FILTER (ctx = 'losing') AS l, avg(g) FILTER (ctx = 'drawing') AS d FROM co GROUP BY coach)
SELECT coach, R(w) AS winning, R(l) AS losing, R(d) AS drawing, CASE WHEN l > 2.4 AND w > 2.2 THEN 'OFFENSIVE' WHEN l <= 2.4 AND w <= 2.2 THEN 'PRAGMATIC' ELSE 'BALANCED' END AS philosophy FROM p""".lstrip(", "), FX)
def a36(spark, d):
    h, a = F.col("home_goals"), F.col("away_goals")
    rows = fixtures(spark, d).select(F.concat("league", "home").alias("coach"), F.when(h > a, "winning").when(h < a, "losing").otherwise("drawing").alias("context"), (h + a).alias("g"))
    p = N.coach_profile(rows, F.col("g"))
    return p.withColumn("philosophy", N.philosophy(F.when(F.col("winning") > 2.2, "hold").when(F.col("winning") <= 2.2, "retreat"), F.when(F.col("losing") > 2.4, "press").when(F.col("losing") <= 2.4, "hold")))


@query("a17_multiclass_scores", NAIVE + """ SELECT seq, R((naive_h - (y = 0)::INT) ** 2 + (naive_d - (y = 1)::INT) ** 2 + (naive_a - (y = 2)::INT) ** 2) AS brier,
  R(-ln(greatest(1e-15, CASE y WHEN 0 THEN naive_h WHEN 1 THEN naive_d ELSE naive_a END))) AS log_loss FROM naive""", FX)
def a17(spark, d):
    from pitchgrid.functions.scoring import multiclass_brier, multiclass_log_loss
    p = [F.col("naive_h"), F.col("naive_d"), F.col("naive_a")]
    return R.trailing_frequencies(fixtures(spark, d)).select("seq", multiclass_brier(p, F.col("actual")).alias("brier"),
                                                             multiclass_log_loss(p, F.col("actual")).alias("log_loss"))
