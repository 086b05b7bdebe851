"""Queries: players, networks, behaviour, scouting, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import load, match_events, matches, passes, player_actions
from pitchgrid.operators.nearest import nearest
from pitchgrid.operators.ordered import mid_rank, top_k
from pitchgrid.plans import networks as N
from pitchgrid.plans import players as P
from pitchgrid.settings import COUNTERS, VECTOR_RANGES

PA = ("player_actions",)
EV = ("match_events",)
_C = ", ".join(COUNTERS)
COUNT_SQL = """
counted AS (SELECT player_id, competition, season,
    count(*) FILTER (action IN ('Pass','Shot','Dribble','Carry')) AS actions, count(*) FILTER (action = 'Pass') AS passes,
    count(*) FILTER (action = 'Pass' AND completed) AS passes_completed,
    count(*) FILTER (action = 'Pass' AND completed AND advance >= 15) AS progressive,
    count(*) FILTER (action = 'Pass' AND shot_assist) AS key_passes, count(*) FILTER (action = 'Pass' AND goal_assist) AS assists,
    count(*) FILTER (action = 'Shot') AS shots, count(*) FILTER (action = 'Shot' AND scored) AS goals,
    count(*) FILTER (action = 'Dribble') AS dribbles, count(*) FILTER (action = 'Dribble' AND won) AS dribbles_completed,
    count(*) FILTER (action IN ('Dispossessed','Miscontrol')) AS turnovers,
    count(DISTINCT match_id) AS matches, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
    any_value(name) AS name, any_value(team) AS team, any_value(position) AS position
  FROM player_actions GROUP BY ALL)"""
ROLL_SQL = COUNT_SQL + f""",
career AS (SELECT player_id, {', '.join(f'sum({c})::BIGINT AS {c}' for c in (*COUNTERS, 'matches'))},
    array_to_string(list_sort(list_distinct(flatten(list(string_split(sources, '|'))))), '|') AS sources,
    any_value(name) AS name, any_value(team) AS team, any_value(position) AS position FROM counted GROUP BY player_id)"""


def profile_sql(src: str) -> str:
    return f"""
prof AS (SELECT *, CASE WHEN actions < 60 THEN 'insufficient_data' WHEN shot_share >= 0.05 AND shots >= 6 THEN 'finisher'
    WHEN key_pass_rate >= 0.035 OR assists >= 3 THEN 'creator'
    WHEN turnover_rate >= 0.04 AND dribbles >= 10 AND dribble_success < 0.6 THEN 'impulsive'
    WHEN pass_accuracy >= 0.85 AND shot_share < 0.02 THEN 'conservative' ELSE 'balanced' END AS label
  FROM (SELECT *, coalesce(passes_completed / nullif(passes, 0), 0) AS pass_accuracy,
    coalesce(progressive / nullif(passes_completed, 0), 0) AS progressive_pass_share, coalesce(key_passes / nullif(passes, 0), 0) AS key_pass_rate,
    coalesce(shots / nullif(actions, 0), 0) AS shot_share, coalesce(turnovers / nullif(actions, 0), 0) AS turnover_rate,
    coalesce(dribbles_completed / nullif(dribbles, 0), 0) AS dribble_success, coalesce(goals / nullif(actions, 0), 0) AS goal_rate,
    coalesce(assists / nullif(actions, 0), 0) AS assist_rate, round(actions / (actions + 60.0::DOUBLE), 3) AS confidence FROM {src}))"""


def scale_sql(col, lo, hi):
    return f"least(1.0, greatest(0.0, ({col} - {lo}) / ({hi} - {lo})))"


RATES = ["pass_accuracy", "progressive_pass_share", "key_pass_rate", "shot_share", "turnover_rate", "dribble_success"]


@query("a02_player_counters", COUNT_SQL + " SELECT * FROM counted", PA)
def a02(spark, d):
    return P.counters(player_actions(spark, d))


@query("a03_s19_career_counters", ROLL_SQL + " SELECT * FROM career", PA)
def a03(spark, d):
    return P.roll_up(P.counters(player_actions(spark, d)))


def _career(spark, d):
    return P.profiles(P.roll_up(P.counters(player_actions(spark, d))))


@query("a04_a05_profiles", ROLL_SQL + "," + profile_sql("career") + f""" SELECT player_id, actions, {', '.join(f'R({r}) AS {r}' for r in RATES)},
  R(confidence) AS confidence, label FROM prof""", PA)
def a04(spark, d):
    return _career(spark, d).select("player_id", "actions", *RATES, "confidence", "label")


@query("a05_season_labels", COUNT_SQL + "," + profile_sql("counted") + " SELECT player_id, competition, season, label FROM prof", PA)
def a05(spark, d):
    return P.profiles(P.counters(player_actions(spark, d))).select("player_id", "competition", "season", "label")


@query("a05_style_labels", COUNT_SQL + "," + profile_sql("counted") + """ SELECT player_id, competition, season,
  CASE WHEN shot_share * 2 > 0.4 AND matches % 4 < 2 THEN 'finisher' WHEN progressive_pass_share > 0.15 AND key_pass_rate * 2 > 0.3 THEN 'creator'
    WHEN turnover_rate > 0.2 AND dribble_success > 0.3 THEN 'impulsive' WHEN turnover_rate < 0.1 AND pass_accuracy > 0.6 THEN 'conservative'
    ELSE 'balanced' END AS style FROM prof""", PA)
def a05_style(spark, d):
    p = P.profiles(P.counters(player_actions(spark, d)))
    c = F.col
    return p.select("player_id", "competition", "season", P.style_label(
        c("shot_share") * 2, F.pmod("matches", F.lit(4)), c("progressive_pass_share"), c("key_pass_rate") * 2, c("turnover_rate"),
        c("dribble_success"), c("turnover_rate"), c("pass_accuracy")).alias("style"))


@query("a06_style_dimensions", ROLL_SQL + "," + profile_sql("career") + f""" SELECT player_id,
  R({scale_sql('pass_accuracy', 0.5, 1.0)}) AS style_pass_accuracy, R({scale_sql('progressive_pass_share', 0.0, 0.4)}) AS style_progressive_pass,
  R({scale_sql('shot_share', 0.0, 0.15)}) AS style_shot_frequency, R({scale_sql('key_pass_rate', 0.0, 0.10)}) AS style_assist_frequency,
  R({scale_sql('turnover_rate', 0.0, 0.10)}) AS style_turnover_rate FROM prof""", PA)
def a06(spark, d):
    p = _career(spark, d)
    return p.select("player_id", *[c for c in p.columns if c.startswith("style_")])


@query("p03_profile_list", ROLL_SQL + "," + profile_sql("career") + """ SELECT player_id, team, label, actions, R(confidence) AS confidence
  FROM prof WHERE team = 'T3' AND actions >= 100 AND confidence >= 0.5 AND label <> 'balanced'""", PA)
def p03(spark, d):
    return _career(spark, d).where("team = 'T3' AND actions >= 100 AND confidence >= 0.5 AND label <> 'balanced'").select(
        "player_id", "team", "label", "actions", "confidence")


@query("k06_most_active", ROLL_SQL + " SELECT player_id, actions FROM career ORDER BY actions DESC, player_id LIMIT 25", PA)
def k06(spark, d):
    return P.roll_up(P.counters(player_actions(spark, d))).orderBy(F.col("actions").desc(), "player_id").limit(25).select("player_id", "actions")


@query("a07_decision_shares", """ SELECT player_id, zone, R(coalesce(s / nullif(s + p + dr + x, 0), 0)) AS shot, R(coalesce(p / nullif(s + p + dr + x, 0), 0)) AS pass,
  R(coalesce(dr / nullif(s + p + dr + x, 0), 0)) AS dribble, R(coalesce(x / nullif(s + p + dr + x, 0), 0)) AS "drop" FROM (
  SELECT player_id, competition AS zone, count(*) FILTER (action = 'Shot') AS s, count(*) FILTER (action = 'Pass') AS p,
    count(*) FILTER (action = 'Dribble') AS dr, count(*) FILTER (action = 'Miscontrol') AS x FROM player_actions GROUP BY ALL)""", PA)
def a07(spark, d):
    a = player_actions(spark, d)
    nxt = F.when(F.col("action") == "Miscontrol", "drop").otherwise(F.lower("action"))
    return P.decision_shares(a.select("player_id", F.col("competition").alias("zone"), nxt.alias("next_action")))


NET = """
edges AS (SELECT match_id, side, src, dst, count(*) AS passes, count(*) FILTER (chance) AS chances FROM passes
  WHERE success AND dst IS NOT NULL GROUP BY ALL),
strength AS (SELECT match_id, side, node, sum(passes)::BIGINT AS strength FROM (
  SELECT match_id, side, src AS node, passes FROM edges UNION ALL SELECT match_id, side, dst, passes FROM edges) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY strength DESC, node) AS rank FROM strength)"""
PS = ("passes",)


def _edges(spark, d):
    return N.edges(passes(spark, d))


@query("a08_passing_network", NET + " SELECT * FROM edges", PS)
def a08(spark, d):
    return _edges(spark, d)


@query("a09_critical_nodes", NET + " SELECT match_id, side, node, strength, rank FROM ranked WHERE rank <= 3", PS)
def a09(spark, d):
    return N.critical_nodes(_edges(spark, d), 3)


@query("a10_network_metrics", NET + """ SELECT s.match_id, s.side, s.n_nodes, e.n_edges, R(1 - s.sq / (s.total * s.total)) AS robustness, R(s.top / s.total) AS dependence,
  R(CASE WHEN n_nodes < 2 THEN 0 ELSE least(1, n_edges / (n_nodes * (n_nodes - 1))) END) AS fluidity
  FROM (SELECT match_id, side, sum(strength)::DOUBLE AS total, sum(strength * strength)::DOUBLE AS sq, max(strength)::DOUBLE AS top, count(*) AS n_nodes FROM strength GROUP BY ALL) s
  JOIN (SELECT match_id, side, count(*) AS n_edges FROM edges GROUP BY ALL) e USING (match_id, side)""", PS)
def a10(spark, d):
    return N.metrics(_edges(spark, d))


@query("a11_network_payload", NET + """ SELECT match_id, side, src, dst, passes, chances, row_number() OVER w AS rank FROM edges e
  WHERE EXISTS (SELECT 1 FROM ranked r WHERE r.rank <= 11 AND r.match_id = e.match_id AND r.side = e.side AND r.node = e.src)
    AND EXISTS (SELECT 1 FROM ranked r WHERE r.rank <= 11 AND r.match_id = e.match_id AND r.side = e.side AND r.node = e.dst)
  WINDOW w AS (PARTITION BY match_id, side ORDER BY passes DESC, src, dst) QUALIFY row_number() OVER w <= 30""", PS)
def a11(spark, d):
    return N.payload(_edges(spark, d))


def _spells(spark, d):
    ev = match_events(spark, d)
    k = F.col("k")
    lineups = ev.where(F.pmod(k, F.lit(4)) == 0).select("match_id", "team", "player_id").distinct()
    pid = lambda x: F.concat(F.lit("p"), x.cast("string"))
    changes = ev.where(((F.col("type") == "foul") & k.between(40, 59)) | (F.col("type") == "red_card")).select(
        "match_id", "team", F.col("event_id").alias("seq"), "minute", F.col("player_id").alias("off_id"),
        F.when(F.col("type") == "foul", pid(k + 1)).alias("on_id"))
    goals = ev.where("type = 'goal'").select("match_id", "team", "minute")
    ends = ev.groupBy("match_id").agg(F.max("minute").alias("match_end"))
    return P.on_off(lineups, changes, goals, ends)


SPELLS = """
chg AS (SELECT match_id, team, event_id AS seq, minute, player_id AS off_id, CASE WHEN type = 'foul' THEN 'p' || (k + 1) END AS on_id
  FROM match_events WHERE (type = 'foul' AND k BETWEEN 40 AND 59) OR type = 'red_card'),
offs AS (SELECT match_id, team, off_id AS player_id, max_by(minute, seq) AS off FROM chg GROUP BY ALL),
ons AS (SELECT match_id, team, on_id AS player_id, max_by(minute, seq) AS start FROM chg WHERE on_id IS NOT NULL GROUP BY ALL),
began AS (SELECT match_id, team, player_id, start FROM ons UNION ALL
  SELECT DISTINCT match_id, team, player_id, 0.0 FROM match_events e WHERE k % 4 = 0 AND (match_id, team, player_id) NOT IN (SELECT match_id, team, player_id FROM ons)),
ends AS (SELECT match_id, max(minute) AS match_end FROM match_events GROUP BY 1),
spells AS (SELECT b.match_id, b.team, b.player_id, b.start, coalesce(o.off, n.match_end) AS "end", n.match_end FROM began b
  LEFT JOIN offs o USING (match_id, team, player_id) JOIN ends n USING (match_id)),
onoff AS (SELECT s.match_id, s.team, s.player_id, greatest(0.0, "end" - start) AS on_min, match_end,
    count(g.minute) FILTER (g.minute BETWEEN start AND "end") AS goals_on, count(g.minute) AS team_goals
  FROM spells s LEFT JOIN (SELECT match_id, team, minute FROM match_events WHERE type = 'goal') g USING (match_id, team)
  GROUP BY s.match_id, s.team, s.player_id, start, "end", match_end)"""


@query("a12_j08_on_off", SPELLS + " SELECT match_id, team, player_id, R(on_min) AS on_min, goals_on, R(match_end) AS match_end, team_goals FROM onoff", EV)
def a12(spark, d):
    return _spells(spark, d)


@query("a13_influence", SPELLS + """ SELECT team, player_id, R(om) AS on_minutes, R(fm) AS off_minutes, R(gn / om * 90) AS rate_on, R((tg - gn) / fm * 90) AS rate_off,
  R(gn / om * 90 - (tg - gn) / fm * 90) AS delta FROM (SELECT team, player_id, sum(on_min) AS om, sum(match_end) - sum(on_min) AS fm, sum(goals_on) AS gn, sum(team_goals) AS tg
  FROM onoff GROUP BY ALL) WHERE om >= 270 AND fm >= 90""", EV)
def a13(spark, d):
    return P.influence(_spells(spark, d))


@query("a30_behaviour_indices", ROLL_SQL + "," + profile_sql("career") + """,
con AS (SELECT match_id, CASE WHEN team = 'HOME' THEN 'AWAY' ELSE 'HOME' END AS team, min(minute) AS conceded FROM match_events WHERE type = 'goal' GROUP BY ALL),
per AS (SELECT e.match_id, e.team, e.player_id, count(*) AS n, count(*) FILTER (type = 'foul') AS fouls, count(*) FILTER (type = 'yellow_card') AS yellows,
    count(*) FILTER (type = 'red_card') AS reds, count(*) FILTER (minute < conceded) AS b, count(*) FILTER (minute >= conceded) AS a, max(minute) AS last, min(conceded) AS conceded
  FROM match_events e LEFT JOIN con USING (match_id, team) GROUP BY ALL),
idx AS (SELECT match_id, per.team, player_id, confidence, least(1, greatest(0, 0.6 * pass_accuracy + 0.4 * (1 - least(1, turnover_rate / 0.10)))) AS s,
    CASE WHEN dribbles >= 5 THEN least(1, greatest(0, dribble_success)) END AS p,
    least(1, greatest(0, 1 - least(1, ((fouls + 2 * yellows + 3 * reds) / CASE WHEN actions > 0 THEN actions ELSE n END) / 0.05))) AS g,
    CASE WHEN conceded IS NOT NULL AND b > 0 THEN least(1, greatest(0, 0.5 * (a / greatest(last - conceded, 1e-9)) / (b / greatest(conceded, 1e-9)))) END AS r
  FROM per JOIN prof USING (player_id))
SELECT match_id, team, player_id, R(s) AS decision_stability, R(p) AS pressure_resistance, R(g) AS aggression_control, R(r) AS resilience, R(confidence) AS confidence,
  concat_ws('|', CASE WHEN s IS NULL THEN 'decision_stability' END, CASE WHEN p IS NULL THEN 'pressure_resistance' END, CASE WHEN g IS NULL THEN 'aggression_control' END, CASE WHEN r IS NULL THEN 'resilience' END) AS abstained FROM idx""",
       ("player_actions", "match_events"))
def a30(spark, d):
    return behaviours(spark, d).drop("reasons")


def behaviours(spark, d):
    prof = _career(spark, d).select("player_id", "actions", "pass_accuracy", "turnover_rate", "dribbles", "dribble_success", "confidence")
    return P.behaviour(prof, match_events(spark, d))


@query("a30_abstention_reasons", ROLL_SQL + "," + profile_sql("career") + """,
con AS (SELECT match_id, CASE WHEN team = 'HOME' THEN 'AWAY' ELSE 'HOME' END AS team, min(minute) AS conceded FROM match_events WHERE type = 'goal' GROUP BY ALL),
per AS (SELECT e.match_id, e.team, e.player_id, min(conceded) AS conceded, count(*) FILTER (minute < conceded) AS b FROM match_events e LEFT JOIN con USING (match_id, team) GROUP BY ALL),
why AS (SELECT match_id, per.team, player_id, unnest([
    CASE WHEN pass_accuracy IS NULL OR turnover_rate IS NULL THEN 'decision_stability:no_shares' END,
    CASE WHEN coalesce(dribbles, 0) < 5 THEN 'pressure_resistance:few_dribbles' WHEN dribble_success IS NULL THEN 'pressure_resistance:no_dribble_success' END,
    CASE WHEN conceded IS NULL THEN 'resilience:nothing_conceded' WHEN b = 0 THEN 'resilience:no_action_before' END,
    'leadership:no_conduct_signals', 'recovery:no_defensive_actions', 'tactical_discipline:no_role_positions']) AS reason FROM per JOIN prof USING (player_id))
SELECT match_id, team, player_id, string_agg(reason, '|' ORDER BY reason) AS reasons FROM why GROUP BY ALL""", ("player_actions", "match_events"))
def a30_reasons(spark, d):
    said = F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return behaviours(spark, d).select("match_id", "team", "player_id", F.sort_array(said).alias("reasons"))


@query("a31_involvement", """ SELECT g.match_id, g.player_id, (g.slot * 15)::BIGINT AS from_minute, count(e.event_id) AS actions FROM (SELECT match_id, player_id, unnest(range(0, last + 1)) AS slot FROM (
    SELECT match_id, player_id, floor(max(minute) / 15)::BIGINT AS last FROM match_events GROUP BY ALL)) g
  LEFT JOIN match_events e ON e.match_id = g.match_id AND e.player_id = g.player_id AND floor(e.minute / 15) = g.slot GROUP BY ALL""", EV)
def a31(spark, d):
    return P.involvement(match_events(spark, d))


def _bios(spark, d):
    s = load(spark, d, "supplier")
    n = F.col("s_suppkey")
    return s.select(F.concat(F.lit("p"), n.cast("string")).alias("player_id"),
                    F.when(F.pmod(n, F.lit(7)) != 0, F.date_add(F.lit("1980-01-01").cast("date"), F.pmod(n * 131, F.lit(9000)).cast("int"))).alias("birth_date"),
                    F.when(F.pmod(n, F.lit(5)) == 0, "wing back").alias("position"))


BIO = """bios AS (SELECT 'p' || s_suppkey AS player_id, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1980-01-01' + (s_suppkey * 131 % 9000)::INTEGER END AS birth_date FROM supplier)"""


@query("f06_ages_f14_factor", BIO + """ SELECT player_id, R(age) AS age, R(CASE WHEN age IS NULL THEN 1 WHEN age <= 19 THEN 1.15 WHEN age >= 32 THEN 0.85
  ELSE round(1.15 + (0.85 - 1.15) / 13 * (age - 19), 4) END) AS factor FROM (SELECT player_id, round((DATE '2003-06-30' - birth_date) / 365.2425::DOUBLE, 2) AS age FROM bios)""".replace("bios AS", "bios AS", 1), ("match_events",))
def f06(spark, d):
    from pitchgrid.functions.clock import age_factor, age_on
    return _bios(spark, d).select("player_id", age_on(F.col("birth_date"), F.lit("2003-06-30").cast("date")).alias("age")).select(
        "player_id", "age", age_factor(F.col("age")).alias("factor"))


@query("w15_mid_rank_percentile", COUNT_SQL + "," + profile_sql("counted") + """ SELECT player_id, competition, season, R((rank() OVER (PARTITION BY competition, season ORDER BY pass_accuracy) - 1
  + 0.5 * count(*) OVER (PARTITION BY competition, season, pass_accuracy)) / count(*) OVER (PARTITION BY competition, season)) AS pct FROM prof""", PA)
def w15(spark, d):
    p = P.profiles(P.counters(player_actions(spark, d)))
    return mid_rank(p, ["competition", "season"], "pass_accuracy", "pct").select("player_id", "competition", "season", "pct")


_PCT = "((rank() OVER (ORDER BY {c}) - 1 + 0.5 * count(*) OVER (PARTITION BY {c})) / count(*) OVER ())::DOUBLE"


@query("w16_scout_ranking", ROLL_SQL + "," + profile_sql("career") + "," + BIO + f""",
pool AS (SELECT player_id, confidence, round((DATE '2003-06-30' - birth_date) / 365.2425::DOUBLE, 2) AS age, (goals + assists) / greatest(actions, 1) AS attack,
    key_pass_rate AS creation, progressive_pass_share AS progression, pass_accuracy - turnover_rate AS security FROM prof LEFT JOIN bios USING (player_id) WHERE actions >= 60),
pct AS (SELECT *, {', '.join(f'{_PCT.format(c=c)} AS p_{c}' for c in P.COMPONENTS)} FROM pool)
SELECT player_id, R(age) AS age, R(perf) AS performance, R(af) AS age_factor, R(least(100, 100 * perf * (0.5 + 0.5 * confidence) * af)) AS score
FROM (SELECT *, (p_attack + p_creation + p_progression + p_security) / 4 AS perf, CASE WHEN age IS NULL THEN 1 WHEN age <= 19 THEN 1.15 WHEN age >= 32 THEN 0.85
  ELSE round(1.15 + (0.85 - 1.15) / 13 * (age - 19), 4) END::DOUBLE AS af FROM pct)""", PA)
def w16(spark, d):
    pool = P.scout_pool(_career(spark, d), _bios(spark, d), F.lit("2003-06-30").cast("date"))
    return P.scout_ranking(pool).select("player_id", "age", "performance", "age_factor", "score")


@query("w16_scout_filtered", ROLL_SQL + "," + profile_sql("career") + "," + BIO + """
SELECT player_id, R(age) AS age FROM (SELECT player_id, round((DATE '2003-06-30' - birth_date) / 365.2425::DOUBLE, 2) AS age, lower(position) AS pos, confidence, actions,
  CASE WHEN substr(player_id, 2)::INT % 5 = 0 THEN 'wing back' END AS bp FROM prof LEFT JOIN bios USING (player_id)) WHERE actions >= 60 AND confidence >= 0.4 AND age <= 21 AND concat_ws(' ', pos, bp) LIKE '%f%'""", PA)
def w16_filtered(spark, d):
    return P.scout_pool(_career(spark, d), _bios(spark, d), F.lit("2003-06-30").cast("date"), min_confidence=0.4, max_age=21, position="F").select("player_id", "age")


@query("w17_a38_season_timeline", COUNT_SQL + """,
starts AS (SELECT competition, year(match_date)::VARCHAR AS season, min(match_date) AS d0 FROM matches GROUP BY ALL)
SELECT player_id, competition, season, actions, d0::VARCHAR AS first_match_date,
  row_number() OVER (PARTITION BY player_id ORDER BY coalesce(d0::VARCHAR, ''), competition, season) AS season_no FROM counted LEFT JOIN starts USING (competition, season)""", ("player_actions", "matches"))
def w17(spark, d):
    m = matches(spark, d).withColumn("season", F.year("match_date").cast("string"))
    return P.season_timeline(P.counters(player_actions(spark, d)), m).select("player_id", "competition", "season", "actions", "first_match_date", "season_no")


def _vec(cols):
    return "[" + ", ".join(cols) + "]::DOUBLE[]"


VEC = _vec([scale_sql(n, lo, hi) for n, lo, hi in VECTOR_RANGES])


@query("m17_similar_players", ROLL_SQL + "," + profile_sql("career") + f""",
v AS (SELECT player_id, team, actions, {VEC} AS vec FROM prof WHERE actions >= 60),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY team ORDER BY actions DESC, player_id) = 1)
SELECT target, candidate, R(s) AS similarity, rank FROM (SELECT t.player_id AS target, v.player_id AS candidate, s, row_number() OVER (PARTITION BY t.player_id ORDER BY round(s, 12) DESC, v.player_id) AS rank
  FROM t, v, LATERAL (SELECT list_cosine_similarity(t.vec, v.vec) AS s) WHERE t.player_id <> v.player_id) WHERE rank <= 5""", PA)
def m17(spark, d):
    p = _career(spark, d).where("actions >= 60").select("player_id", "team", "actions", P.style_vector().alias("vec"))
    targets = top_k(p, ["team"], [F.col("actions").desc(), F.col("player_id")], 1)
    cols = [F.col("player_id").alias("id"), "vec"]
    return nearest(targets.select(*cols), p.select(*cols), 5)


EMB = """SELECT target, candidate, R(s) AS similarity, rank FROM (SELECT t.vec_id::VARCHAR AS target, c.vec_id::VARCHAR AS candidate, s,
    row_number() OVER (PARTITION BY t.vec_id ORDER BY round(s, 12) DESC, c.vec_id::VARCHAR) AS rank
  FROM {targets} t, embeddings c, LATERAL (SELECT list_cosine_similarity(t.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s) WHERE t.vec_id <> c.vec_id) WHERE rank <= {k}"""


def _vectors(spark, d):
    e = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label", "vec_id")


@query("v06_j14_k01_nearest_per_label", EMB.format(targets="(SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)", k=10))
def v06(spark, d):
    v = _vectors(spark, d)
    targets = v.groupBy("label").agg(F.min_by(F.struct("id", "vec"), "vec_id").alias("r")).select("r.*")
    return nearest(targets, v, 10)


@query("v06_j14_all_nearest_blocked", EMB.format(targets="embeddings", k=3))
def v06_all(spark, d):
    v = _vectors(spark, d)
    return nearest(v, v, 3)
