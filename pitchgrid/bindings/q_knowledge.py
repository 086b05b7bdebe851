"""Queries: knowledge timelines, integrity, graph and sharing."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import functions as F

from pitchgrid.bindings import q_matches, q_models, q_players, q_state
from pitchgrid.bindings import state_sql as Q
from pitchgrid.bindings.registry import ORACLES, query
from pitchgrid.bindings.tables import knowledge, load, match_events, matches
from pitchgrid.operators.ordered import multiset_new
from pitchgrid.plans import knowledge as K
from pitchgrid.plans import snapshots as S
from pitchgrid.shared import new_folder

KN = ("knowledge",)
CTX = ["competition", "season", "match_id", "team", "player_id", "minute"]
DATES = [datetime.date(1995 + i // 2, 1 + 6 * (i % 2), 1) for i in range(13)]
DATES_SQL = "(VALUES " + ", ".join(f"(DATE '{x}')" for x in DATES) + ") dd(as_of)"

TIMELINE = """
perm AS (SELECT k.*, player_id AS entity, lead(id) OVER w AS next_id, lead(valid_from) OVER w AS next_from FROM knowledge k
  WHERE permanence = 'permanent' WINDOW w AS (PARTITION BY kind, player_id ORDER BY seq)),
timeline AS (
  SELECT seq, kind, layer, entity, player_id, value, source, collected_at, valid_from, permanence, confidence, id,
    CASE WHEN valid_to IS NULL AND next_id IS NOT NULL THEN coalesce(next_from, DATE '0001-01-01') ELSE valid_to END AS valid_to,
    CASE WHEN valid_to IS NULL AND next_id IS NOT NULL THEN next_id END AS superseded_by FROM perm
  UNION ALL BY NAME
  SELECT seq, kind, layer, player_id AS entity, player_id, value, source, collected_at, valid_from, permanence, confidence, id,
    valid_to, NULL AS superseded_by FROM knowledge WHERE permanence <> 'permanent')"""
RANK = "(permanence = 'temporary')::INT DESC, coalesce(valid_from, DATE '0001-01-01') DESC, coalesce(confidence, -1) DESC, id DESC"
ACTIVE = "(valid_from IS NULL OR valid_from <= as_of) AND (valid_to IS NULL OR as_of < valid_to)"


def _timeline(spark, d):
    return K.build_timeline(K.with_entity(knowledge(spark, d)))


@query("n01_f03_record_ids", """ SELECT seq, substr(sha256(to_json([layer, kind, competition, season, match_id, team, player_id, source])::VARCHAR), 1, 16) AS logical_id,
  substr(sha256(to_json([layer, kind, competition, season, match_id, team, player_id, source, value, collected_at::VARCHAR])::VARCHAR), 1, 16) AS record_id FROM knowledge""", KN)
def n01(spark, d):
    return K.with_ids(knowledge(spark, d), CTX[:5]).select("seq", "logical_id", "record_id")


@query("f24_entity_keys", " SELECT seq, kind, coalesce(CASE WHEN seq % 2 = 0 THEN player_id END, team, match_id) AS entity FROM knowledge", KN)
def f24(spark, d):
    k = knowledge(spark, d).withColumn("player_id", F.when(F.pmod("seq", F.lit(2)) == 0, F.col("player_id")))
    return K.with_entity(k).select("seq", "kind", "entity")


@query("w20_timeline", TIMELINE + """ SELECT id, kind, entity, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to,
  superseded_by, permanence FROM timeline""", KN)
def w20(spark, d):
    return _timeline(spark, d).select("id", "kind", "entity", "valid_from", "valid_to", "superseded_by", "permanence")


@query("j09_w22_state_as_of", TIMELINE + f""" SELECT kind, entity, as_of::VARCHAR AS as_of, id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, entity, as_of ORDER BY {RANK}) AS rk FROM timeline, {DATES_SQL} WHERE {ACTIVE}) WHERE rk = 1""", KN)
def j09(spark, d):
    return K.state_as_of(_timeline(spark, d), DATES).select("kind", "entity", F.col("at").alias("as_of"), "id", "value")


@query("w21_current_state", TIMELINE + """ SELECT kind, entity, id, value FROM timeline
  WHERE permanence = 'permanent' AND valid_to IS NULL AND superseded_by IS NULL
  QUALIFY row_number() OVER (PARTITION BY kind, entity ORDER BY coalesce(valid_from, DATE '0001-01-01') DESC, id DESC) = 1""", KN)
def w21(spark, d):
    return K.current_state(_timeline(spark, d)).select("kind", "entity", "id", "value")


@query("w21_n11_history", TIMELINE + """ SELECT kind, entity, id, valid_from::VARCHAR AS valid_from,
  row_number() OVER (PARTITION BY kind, entity ORDER BY coalesce(valid_from, DATE '0001-01-01'), id) AS version FROM timeline""", KN)
def w21_history(spark, d):
    from pitchgrid.operators.ordered import numbered
    start = F.coalesce("valid_from", F.lit(K.ALWAYS).cast("date"))
    rows = numbered(_timeline(spark, d), K.KEY, start, [start, F.col("id")], "version")
    return rows.select("kind", "entity", "id", "valid_from", "version")


@query("n04_future_leaks", """ SELECT id, reason FROM (SELECT id, CASE WHEN valid_from > DATE '1998-07-01' THEN 'valid later'
    WHEN collected_at > DATE '1998-07-01' THEN 'collected later'
    WHEN layer NOT IN ('observed','historical','youth','external','derived') THEN 'layer not allowed' END AS reason FROM knowledge)
  WHERE reason IS NOT NULL""", KN)
def n04(spark, d):
    return K.future_leaks(knowledge(spark, d), F.lit("1998-07-01").cast("date")).select("id", "reason")


@query("n05_pre_match_state", TIMELINE + f""" SELECT kind, entity, as_of::VARCHAR AS as_of, id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, entity, as_of ORDER BY {RANK}) AS rk FROM timeline, {DATES_SQL}
  WHERE {ACTIVE} AND (collected_at IS NULL OR collected_at <= as_of) AND layer IN ('observed','historical','youth','external','derived')) WHERE rk = 1""", KN)
def n05(spark, d):
    return K.assemble_state(_timeline(spark, d), DATES).select("kind", "entity", F.col("at").alias("as_of"), "id", "value")


@query("n06_gated_simulations", " SELECT id, layer, 'audit:passed' AS transformations FROM knowledge WHERE layer = 'simulated'", KN)
def n06(spark, d):
    sim = knowledge(spark, d).where("layer = 'simulated'").withColumn("transformations", F.array().cast("array<string>"))
    return K.gate(sim, audited=True).select("id", "layer", "transformations")


@query("n02_idempotent_store", """ SELECT id, any_value(kind) AS kind, R(max_by(confidence, load)) AS confidence FROM (
    SELECT id, kind, coalesce(confidence, 0) AS confidence, 0 AS load FROM knowledge WHERE seq % 10 < 7
    UNION ALL SELECT id, kind, 1.0, 1 FROM knowledge WHERE seq % 10 >= 5) GROUP BY id""", KN)
def n02(spark, d):
    k = knowledge(spark, d).select("id", "kind", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "seq")
    m = F.pmod("seq", F.lit(10))
    return K.store(k.where(m < 7).drop("seq"), k.where(m >= 5).withColumn("confidence", F.lit(1.0)).drop("seq"))


ROSTER = "(SELECT 'p' || c_custkey AS player_id FROM customer WHERE c_nationkey <> 3)"
CATALOG = "(SELECT DISTINCT 'f' || (o_orderkey // 6) AS match_id FROM orders WHERE o_orderkey // 6 % 40 <> 1)"


@query("n03_j19_integrity_violations", f"""
  SELECT 'no provenance' AS rule, id AS key, '' AS detail FROM knowledge WHERE coalesce(source, '') = ''
  UNION ALL SELECT 'no evidence', id, '' FROM knowledge WHERE layer IN ('derived','probabilistic','simulated','experimental') AND parent IS NULL AND pipeline_version IS NULL
  UNION ALL SELECT 'event without match', id, '' FROM knowledge WHERE minute IS NOT NULL AND match_id IS NULL
  UNION ALL SELECT 'player on two teams', match_id || '/' || player_id, min(team) || ' & ' || max(team) FROM knowledge
    WHERE team IS NOT NULL AND match_id IS NOT NULL GROUP BY match_id, player_id HAVING min(team) <> max(team)
  UNION ALL SELECT 'unknown player', id, player_id FROM knowledge WHERE player_id NOT IN {ROSTER}
  UNION ALL SELECT 'unknown match', id, match_id FROM knowledge WHERE match_id IS NOT NULL AND match_id NOT IN {CATALOG}""".replace(
    "\n  SELECT 'no prov", " SELECT 'no prov", 1), KN)
def n03(spark, d):
    k = knowledge(spark, d)
    roster = load(spark, d, "customer").where("c_nationkey <> 3").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("player_id"))
    fid = F.expr("cast(floor(o_orderkey / 6) as bigint)")
    catalog = load(spark, d, "orders").where(F.pmod(fid, F.lit(40)) != 1).select(F.concat(F.lit("f"), fid.cast("string")).alias("match_id")).distinct()
    return K.integrity(k, roster, catalog)


@query("n03_isolation_rules", """ SELECT player_id, unnest(list_filter([
    CASE WHEN min(match_id) <> max(match_id) THEN 'several matches' END,
    CASE WHEN min(coalesce(competition, '?') || '/' || coalesce(season, '?')) <> max(coalesce(competition, '?') || '/' || coalesce(season, '?')) THEN 'several seasons' END,
    CASE WHEN min(layer) <> max(layer) THEN 'several layers' END,
    CASE WHEN count(*) FILTER (layer IN ('observed','historical','youth','external')) NOT IN (0, count(*)) THEN 'facts mixed with inference' END],
    lambda r: r IS NOT NULL)) AS rule FROM knowledge GROUP BY player_id""", KN)
def n03_isolation(spark, d):
    return K.isolation(knowledge(spark, d), ["player_id"])


@query("n03_aggregate_mismatch", """ SELECT m.match_id, m.home_goals_final::VARCHAR AS expected, coalesce(n, 0) AS observed FROM matches m
  LEFT JOIN (SELECT match_id, count(*) AS n FROM match_events WHERE type = 'goal' AND team = 'HOME' GROUP BY 1) e USING (match_id)
  WHERE m.home_goals_final <> coalesce(n, 0)""", ("matches",))
def n03_aggregate(spark, d):
    goals = match_events(spark, d).where("type = 'goal' AND team = 'HOME'")
    stored = matches(spark, d).select("match_id", F.col("home_goals_final").cast("string").alias("expected"))
    return K.aggregate_mismatch(stored, goals, ["match_id"])


@query("w28_chronology", """ SELECT match_id, event_id, R(minute) AS minute, R(latest) AS latest FROM (
  SELECT *, max(minute) OVER (PARTITION BY match_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM (SELECT match_id, event_id, minute, (event_id // 100) * 100 + (event_id * 37 % 100) AS seq FROM match_events)) WHERE minute < latest""", ("match_events",))
def w28(spark, d):
    ev = match_events(spark, d).withColumn("seq", F.expr("cast(floor(event_id / 100) as bigint)") * 100 + F.pmod(F.col("event_id") * 37, F.lit(100)))
    return K.chronology(ev, ["match_id"], 1000).select("match_id", "event_id", "minute", "latest")


@query("a29_store_audit", " SELECT layer, count(*) AS records, count(DISTINCT match_id) AS matches FROM knowledge GROUP BY layer", KN)
def a29(spark, d):
    return K.audit(knowledge(spark, d))


@query("p04_current_records", """ SELECT id, kind, layer FROM (""" + "WITH " + TIMELINE.strip() + """ SELECT * FROM timeline)
  WHERE valid_to IS NULL AND superseded_by IS NULL""", KN)
def p04(spark, d):
    return _timeline(spark, d).where("valid_to IS NULL AND superseded_by IS NULL").select("id", "kind", "layer")


@query("p12_f18_flattened", """ SELECT id, '{' || concat_ws(',', '"competition":"' || competition || '"', '"season":"' || season || '"',
  '"match_id":"' || match_id || '"', '"team":"' || team || '"', '"player_id":"' || player_id || '"') || '}' AS context FROM knowledge""", KN)
def p12(spark, d):
    return K.flatten(knowledge(spark, d), CTX[:5])


@query("f18_json_round_trip", " SELECT id, competition, season, match_id, team, player_id, R(minute) AS minute FROM knowledge", KN)
def f18(spark, d):
    flat = K.flatten(knowledge(spark, d), CTX)
    schema = "competition string, season string, match_id string, team string, player_id string, minute double"
    return flat.select("id", F.from_json("context", schema).alias("c")).select("id", "c.*")


@query("f20_enrich_context", """ SELECT k.id, coalesce(k.team, e.team) AS team, coalesce(k.season, e.season) AS season,
  concat_ws('|', CASE WHEN k.team <> e.team THEN 'team' END, CASE WHEN k.season <> e.season THEN 'season' END) AS conflicts
  FROM knowledge k LEFT JOIN (SELECT 'p' || c_custkey AS player_id, 'T' || (c_custkey % 12) AS team, '1997' AS season FROM customer WHERE c_custkey % 9 <> 0) e USING (player_id)""", KN)
def f20(spark, d):
    c = load(spark, d, "customer").where(F.pmod("c_custkey", F.lit(9)) != 0)
    extra = c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("player_id"),
                     F.concat(F.lit("T"), F.pmod("c_custkey", F.lit(12)).cast("string")).alias("team"), F.lit("1997").alias("season"))
    return K.enrich(knowledge(spark, d), extra, "player_id", ["team", "season"]).select("id", "team", "season", "conflicts")


@query("f21_provenance_chain", """ SELECT id, 'load|fuse' AS transformations, CASE WHEN parent IS NULL THEN 'root' WHEN parent = 'root' THEN 'root'
  ELSE parent || '|root' END AS parents FROM knowledge""", KN)
def f21(spark, d):
    steps, parents = K.with_transformation(F.array(F.lit("load")), F.array_compact(F.array("parent")), "fuse",
                                           F.array_compact(F.array("parent", F.lit("root"))))
    return knowledge(spark, d).select("id", steps.alias("transformations"), parents.alias("parents"))


EDGES = """
raw_edges AS (
  SELECT 'player:' || player_id AS src, 'appeared_in' AS relation, 'match:' || match_id AS dst, source, valid_from, valid_to FROM knowledge
  UNION ALL SELECT 'player:' || player_id, 'played_for', 'team:' || team, source, valid_from, valid_to FROM knowledge
  UNION ALL SELECT 'team:' || team, 'competed_in', 'match:' || match_id, source, valid_from, valid_to FROM knowledge
  UNION ALL SELECT 'match:' || match_id, 'part_of', 'competition:' || competition, source, valid_from, valid_to FROM knowledge
  UNION ALL SELECT 'player:' || player_id, 'active_in', 'competition:' || competition, source, valid_from, valid_to FROM knowledge),
edges AS (SELECT src, relation, dst, count(*) AS n, coalesce(string_agg(DISTINCT source, '|' ORDER BY source), '') AS sources,
    CASE WHEN count(*) = count(valid_from) THEN min(valid_from) END AS valid_from,
    CASE WHEN count(*) = count(valid_to) THEN max(valid_to) END AS valid_to
  FROM raw_edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL)"""


def _edges(spark, d):
    return K.graph_edges(knowledge(spark, d))


@query("a28_n08_graph_edges", EDGES + """ SELECT src, relation, dst, n, sources, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM edges""", KN)
def a28(spark, d):
    return _edges(spark, d)


@query("n08_faced_edges", """SELECT 'team:' || home AS src, 'team:' || away AS dst, count(*) AS n, min(date)::VARCHAR AS valid_from, max(date)::VARCHAR AS valid_to
  FROM fixtures GROUP BY ALL""", ("fixtures",))
def n08_faced(spark, d):
    """Edges between teams that met, from records with both sides as context."""
    from pitchgrid.bindings.tables import fixtures
    none = F.lit(None).cast("string")
    records = fixtures(spark, d).select(
        "home", "away", F.lit("results").alias("source"), F.col("date").alias("valid_from"), F.col("date").alias("valid_to"),
        none.alias("player_id"), none.alias("team"), none.alias("match_id"), none.alias("competition"))
    return K.graph_edges(records).where("relation = 'faced'").select("src", "dst", "n", "valid_from", "valid_to")


@query("u05_graph_nodes", EDGES + """ SELECT DISTINCT key, split_part(key, ':', 1) AS type FROM (
  SELECT src AS key FROM edges UNION ALL SELECT dst FROM edges)""", KN)
def u05(spark, d):
    return K.nodes(_edges(spark, d))


@query("n09_neighbours", EDGES + """ SELECT node, direction, relation, n FROM (
  SELECT CASE WHEN src = 'team:T3' THEN dst ELSE src END AS node, CASE WHEN src = 'team:T3' THEN 'out' ELSE 'in' END AS direction, relation, n, src, dst
  FROM edges WHERE (src = 'team:T3' OR dst = 'team:T3') AND (valid_from IS NULL OR valid_from <= DATE '1999-01-01') AND (valid_to IS NULL OR DATE '1999-01-01' < valid_to))
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, src, relation, dst) = 1""", KN)
def n09(spark, d):
    return K.neighbours(_edges(spark, d), "team:T3", at=F.lit("1999-01-01").cast("date"))


@query("k02_top_edges", EDGES + " SELECT src, relation, dst, n FROM edges ORDER BY n DESC, src, relation, dst LIMIT 50", KN)
def k02(spark, d):
    return K.top_edges(_edges(spark, d), 50).select("src", "relation", "dst", "n")


POLICY = {"default": "local_only", "by_layer": {"observed": "syncable", "derived": "syncable"},
          "by_kind": {"5-LOW": "local_only", "2-HIGH": "syncable"}, "local_sources": ["gamma"]}


@query("n10_sharing_policy", """ SELECT id, CASE WHEN source = 'gamma' THEN 'local_only' WHEN kind = '5-LOW' THEN 'local_only'
  WHEN kind = '2-HIGH' THEN 'syncable' WHEN layer IN ('observed', 'derived') THEN 'syncable' ELSE 'local_only' END AS sharing FROM knowledge""", KN)
def n10(spark, d):
    return K.classify_sharing(knowledge(spark, d), POLICY).select("id", "sharing")


@query("u04_syncable_export", """ SELECT sharing, count(*) AS n FROM (SELECT CASE WHEN source = 'gamma' THEN 'local_only' WHEN kind = '5-LOW' THEN 'local_only'
  WHEN kind = '2-HIGH' THEN 'syncable' WHEN layer IN ('observed', 'derived') THEN 'syncable' ELSE 'local_only' END AS sharing FROM knowledge) GROUP BY 1""", KN)
def u04(spark, d):
    marked = K.classify_sharing(knowledge(spark, d), POLICY)
    local, sync = marked.where("sharing = 'local_only'"), marked.where("sharing = 'syncable'")
    return local.unionByName(sync).groupBy("sharing").agg(F.count("*").alias("n"))


@query("n07_lifted_predictions", Q.PANEL + """ SELECT match_id, t AS minute, kind, 'probabilistic' AS layer, R(value) AS value,
  'engine' AS source, 'prediction/poisson' AS pipeline_version, R(confidence) AS confidence FROM (
  SELECT match_id, t, confidence, 'pred_goal_next_5min' AS kind, 1 - exp(-lam * 5) AS value FROM panels
  UNION ALL SELECT match_id, t, confidence, 'pred_goal_next_10min', 1 - exp(-lam * 10) FROM panels
  UNION ALL SELECT match_id, t, confidence, 'pred_next_goal_home', lam_home / lam FROM panels)""", ("match_events",))
def n07(spark, d):
    p = S.panel(match_events(spark, d))
    return K.lift(p, ["goal_next_5min", "goal_next_10min", "next_goal_home"], "pred_", "probabilistic",
                  "prediction/poisson", ["match_id", "minute"], F.col("confidence"))


def _lifted_sql() -> str:
    """Number and mean of each field of each kind, from the SQL of the outputs that are lifted."""
    fields = {
        "m15_panel": [("pred_goal_next_5min", "", "goal_next_5min"), ("pred_goal_next_10min", "", "goal_next_10min"), ("pred_goal_before_half", "", "goal_before_half"),
                      ("pred_next_goal", "home", "next_goal_home"), ("pred_next_goal", "away", "1 - next_goal_home"), ("pred_next_goal", "confidence", "confidence")],
        "m11_outcome_projection": [("sim_outcome", "home", "home_win"), ("sim_outcome", "draw", "draw"), ("sim_outcome", "away", "away_win"), ("sim_expected_goals", "home", "expected_home"),
                                   ("sim_expected_goals", "away", "expected_away"), ("sim_goal_prob", "any", "goal_any")],
        "a04_a05_profiles": [("player_profile", "actions", "actions"), ("player_profile", "pass_accuracy", "pass_accuracy"), ("player_profile", "shot_share", "shot_share"), ("player_profile", "confidence", "confidence")],
        "a30_behaviour_indices": [("behavioral_profile", c, c) for c in ("decision_stability", "pressure_resistance", "aggression_control", "resilience")],
        "a23_a24_competition_summary": [("competition_strength", "", "goals_per_match")],
        "f16_match_vectors": [("match_vector", "size", "dim + 1")],
        "w14_schedule_context": [("team_context", "rest_days", "rest_days"), ("team_context", "congestion", "congestion")],
    }
    parts = [f"SELECT '{kind}' AS kind, '{field}' AS field, count({number}) AS n, round(avg({number}), 4) AS mean FROM ({ORACLES[of]})" for of, rows in fields.items() for kind, field, number in rows]
    return " UNION ALL ".join(parts)


def n07_all(spark, d):
    """All outputs lifted into one table and read back in their types: number and mean of each field."""
    context = q_matches.w14(spark, d).withColumn("venue", F.lit(None).cast("string"))
    records = K.lift_outputs(
        panels=q_state.m15(spark, d), projections=q_models.m11(spark, d), profiles=q_players.a04(spark, d), vectors=q_matches.M.match_vectors(match_events(spark, d)),
        behaviours=q_players.behaviours(spark, d), contexts=context, strengths=q_matches.a24(spark, d), source_version="closed form")
    records = stored_records(records)
    fields = {"pred_next_goal": ("home", "away"), "sim_outcome": ("home", "draw", "away"), "sim_expected_goals": ("home", "away"), "sim_goal_prob": ("any",),
              "player_profile": ("actions", "pass_accuracy", "shot_share"), "behavioral_profile": ("decision_stability", "pressure_resistance", "aggression_control", "resilience"),
              "team_context": ("rest_days", "congestion")}
    long = []
    for kind in K.LIFTED:
        rows = K.typed_values(records, kind)
        values = [F.struct(F.lit(f).alias("field"), F.col(f"value.{f}").cast("double").alias("number")) for f in fields.get(kind, ())]
        if kind in ("pred_next_goal", "player_profile"):
            values.append(F.struct(F.lit("confidence").alias("field"), F.col("confidence").alias("number")))
        if kind == "match_vector":  # every place of the vector counts once
            values = [F.struct(F.lit("size").alias("field"), (F.col("place") + 1).cast("double").alias("number"))]
            rows = rows.select("kind", F.posexplode("value").alias("place", "entry"))
        values = values or [F.struct(F.lit("").alias("field"), F.col("value").cast("double").alias("number"))]
        long.append(rows.select("kind", F.explode(F.array(*values)).alias("v")).select("kind", "v.*"))
    every = reduce(lambda a, b: a.unionByName(b), long)
    return every.groupBy("kind", "field").agg(F.count("number").alias("n"), F.round(F.avg("number"), 4).alias("mean"))


def stored_records(records):
    """Records by kind, written without sorting a task's rows: a writer of small row groups stays open for each kind."""
    path, conf, name = new_folder(records.sparkSession, "lifted"), records.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    was = conf.get(name, None)
    conf.set(name, len(K.LIFTED) + 1)
    try:
        records.write.partitionBy("kind").option("parquet.block.size", 8 << 20).parquet(path)
    finally:
        conf.unset(name) if was is None else conf.set(name, was)
    return records.sparkSession.read.schema(records.schema).parquet(path)


@query("j12_u03_t02_multiset_new", """ SELECT event_id FROM (
    SELECT event_id, match_id, type, team, floor(minute) AS m, row_number() OVER (PARTITION BY match_id, type, team, floor(minute) ORDER BY event_id) AS occ FROM match_events)
  LEFT JOIN (SELECT match_id, type, team, floor(minute) AS m, count(*) AS have FROM match_events WHERE event_id % 3 <> 0 GROUP BY ALL) USING (match_id, type, team, m)
  WHERE occ > coalesce(have, 0)""", ("match_events",))
def j12(spark, d):
    ev = match_events(spark, d).withColumn("m", F.floor("minute"))
    stored = ev.where(F.pmod("event_id", F.lit(3)) != 0)
    return multiset_new(ev, stored, ["match_id", "type", "team", "m"], [F.col("event_id")], F.floor(F.col("event_id") / 10000)).select("event_id")


query("n07_lifted_outputs", _lifted_sql())(n07_all)
