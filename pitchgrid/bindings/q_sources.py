"""Queries: source parsing and sinks, fed with documents derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import fixtures, load, match_events, matches
from pitchgrid.plans import matches as M
from pitchgrid.plans import players as P
from pitchgrid.shared import cut, new_folder
from pitchgrid.sources import entities, match_detail, open_format, provider_events, results, tables, versions

EV = ("match_events",)
EM = ("match_events", "matches")
FX = ("fixtures",)


# provider events ------------------------------------------------------------ #
def _raw(spark, d):
    """Provider-shaped JSON lines, one per event, parsed back with the provider schema."""
    ev = match_events(spark, d).join(matches(spark, d).select("match_id", "home_team", "away_team"), "match_id")
    k, kind = F.col("k"), F.col("type")
    named = lambda c: F.struct(c.alias("name"))
    person = lambda i: F.struct(i.cast("bigint").alias("id"), F.concat(F.lit("Player "), i.cast("string")).alias("name"))
    own = (kind == "goal") & (F.pmod(k, F.lit(10)) == 0)
    name = (F.when(own, "Own Goal For").when(kind.isin("shot", "shot_on_target", "goal"), "Shot").when(kind.isin("corner", "pass"), "Pass")
            .when((kind == "foul") | ((kind == "yellow_card") & (k < 75)) | ((kind == "red_card") & (k < 95)), "Foul Committed").otherwise("Bad Behaviour"))
    shot = (F.when(kind == "goal", "Goal").when((kind == "shot_on_target") & (k < 50), "Saved").when(kind == "shot_on_target", "Saved to Post")
            .when(k < 50, "Off T").otherwise("Blocked"))
    card = F.when(kind == "yellow_card", "Yellow Card").when((kind == "red_card") & (k < 95), "Second Yellow").when(kind == "red_card", "Red Card")
    m4 = F.pmod(k, F.lit(4))
    team = F.when(k == 13, "Nobody FC").when(F.col("team") == "HOME", F.col("home_team")).otherwise(F.col("away_team"))
    x, y = F.col("x") * 1.2, F.col("y") * 0.8
    pass_ = F.struct(named(F.when(kind == "corner", "Corner")).alias("type"), F.when(m4 == 1, named(F.lit("Incomplete"))).alias("outcome"),
                     F.array(F.least(x + 20.0, F.lit(120.0)), y).alias("end_location"), F.when(m4 != 0, person(k + 1)).alias("recipient"),
                     (F.pmod(k, F.lit(7)) == 0).alias("shot_assist"), (F.pmod(k, F.lit(11)) == 0).alias("goal_assist"))
    whole = F.floor("minute")
    doc = F.struct(
        "match_id", F.col("event_id").alias("event_no"), whole.cast("int").alias("minute"), F.floor((F.col("minute") - whole) * 60).cast("int").alias("second"),
        F.when(k == 59, 5).when(F.col("minute") < 47.5, 1).otherwise(2).alias("period"), (k / 100.0).alias("duration"), named(name).alias("type"), named(team).alias("team"),
        person(k).alias("player"), named(F.lit("MF")).alias("position"), F.when(k != 17, F.array(x, y)).alias("location"),
        F.when(name == "Shot", F.struct(named(shot).alias("outcome"), (k / 100.0).alias("statsbomb_xg"), F.array(F.lit(120.0), F.lit(40.0)).alias("end_location"))).alias("shot"),
        F.when(name == "Pass", pass_).alias("pass"), F.when(name == "Foul Committed", F.struct(F.when(card.isNotNull(), named(card)).alias("card"))).alias("foul_committed"),
        F.when(name == "Bad Behaviour", F.struct(named(card).alias("card"))).alias("bad_behaviour"))
    # writing and parsing cost far more than reading, so the rows are spread over all cores whatever the size of the files
    spread = ev.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id", "minute")
    return provider_events.parse_raw(spread.select(F.to_json(doc).alias("json")))


RAW = """
raw AS (SELECT e.event_id, e.match_id, type AS kind, k, x, y, CASE WHEN k = 13 THEN NULL ELSE team END AS side, team AS real_side, floor(minute) AS mi, floor((minute - floor(minute)) * 60) AS se,
    CASE WHEN k = 59 THEN 5 WHEN minute < 47.5 THEN 1 ELSE 2 END AS period, home_team, away_team,
    CASE WHEN k = 13 THEN 'Nobody FC' WHEN team = 'HOME' THEN home_team ELSE away_team END AS team_name,
    CASE WHEN type = 'goal' AND k % 10 = 0 THEN 'Own Goal For' WHEN type IN ('shot', 'shot_on_target', 'goal') THEN 'Shot' WHEN type IN ('corner', 'pass') THEN 'Pass'
      WHEN type = 'foul' OR (type = 'yellow_card' AND k < 75) OR (type = 'red_card' AND k < 95) THEN 'Foul Committed' ELSE 'Bad Behaviour' END AS name
  FROM match_events e JOIN matches m USING (match_id)),
norm AS (SELECT event_id AS event_no, match_id, mi + se / 60.0::DOUBLE AS minute, side AS team, t AS type, k::VARCHAR AS player_id, CASE WHEN k <> 17 THEN x END AS x, CASE WHEN k <> 17 THEN y END AS y, CASE WHEN name = 'Shot' THEN k / 100.0 END AS xg
  FROM raw, unnest(CASE kind WHEN 'goal' THEN CASE WHEN name = 'Shot' THEN ['shot_on_target', 'goal'] ELSE ['goal'] END WHEN 'pass' THEN []::VARCHAR[]
    WHEN 'yellow_card' THEN CASE WHEN k < 75 THEN ['foul', 'yellow_card'] ELSE ['yellow_card'] END WHEN 'red_card' THEN CASE WHEN k < 95 THEN ['foul', 'red_card'] ELSE ['red_card'] END ELSE [kind] END) u(t)
  WHERE side IS NOT NULL AND period <> 5)"""


def _heads(spark, d):
    return matches(spark, d).select("match_id", "home_team", "away_team", "match_date", "home_goals_final", "away_goals_final")


@query("s01_normalized_events", RAW + " SELECT event_no, match_id, R(minute) AS minute, team, type, player_id, R(x) AS x, R(y) AS y, R(xg) AS xg FROM norm", EM)
def s01(spark, d):
    return provider_events.normalize(_raw(spark, d), _heads(spark, d))


@query("s01_without_own_goals", RAW + " SELECT team, type, count(*) AS n FROM norm JOIN raw ON raw.event_id = norm.event_no WHERE name <> 'Own Goal For' GROUP BY ALL", EM)
def s01_plain(spark, d):
    return provider_events.normalize(_raw(spark, d), _heads(spark, d), own_goals=False).groupBy("team", "type").agg(F.count("*").alias("n"))


@query("s02_ball_stream", RAW + """ SELECT event_id AS event_no, match_id, R(mi * 60 + se) AS t, name AS type, CASE WHEN team_name = home_team THEN 'HOME' ELSE 'AWAY' END AS team, R(x) AS x, R(y) AS y,
  R(CASE name WHEN 'Pass' THEN least(x * 1.2 + 20, 120) * 100 / 120 WHEN 'Shot' THEN 100 END) AS x2, R(CASE WHEN name IN ('Pass', 'Shot') THEN k / 100.0 END) AS dur,
  CASE WHEN name = 'Shot' THEN CASE WHEN kind = 'goal' THEN 'Goal' WHEN kind = 'shot_on_target' THEN CASE WHEN k < 50 THEN 'Saved' ELSE 'Saved to Post' END WHEN k < 50 THEN 'Off T' ELSE 'Blocked' END END AS outcome
  FROM raw WHERE name IN ('Pass', 'Shot', 'Foul Committed') AND k <> 17""", EM)
def s02(spark, d):
    return provider_events.ball_stream(_raw(spark, d), _heads(spark, d)).select("event_no", "match_id", "t", "type", "team", "x", "y", "x2", "dur", "outcome")


@query("s03_pass_records", RAW + """ SELECT event_id AS event_no, match_id, team_name AS team, k::VARCHAR AS src, CASE WHEN k % 4 <> 0 THEN (k + 1)::VARCHAR END AS dst,
  (k % 4 NOT IN (0, 1))::BIGINT AS success, (k % 7 = 0 OR k % 11 = 0)::BIGINT AS chance FROM raw WHERE name = 'Pass'""", EM)
def s03(spark, d):
    return provider_events.pass_records(_raw(spark, d))


@query("s04_match_headers", RAW + " SELECT m.match_id, home_team, away_team, coalesce(floor(max(n.minute)) + 1, 91)::BIGINT AS duration FROM matches m LEFT JOIN norm n USING (match_id) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY m.match_id, home_team, away_team"), EM)
def s04(spark, d):
    heads = _heads(spark, d)
    return provider_events.match_headers(provider_events.normalize(_raw(spark, d), heads), heads).select("match_id", "home_team", "away_team", "duration")


@query("s10_a14_match_facts", RAW + """ SELECT m.match_id, coalesce(ht_home, 0) AS ht_home, coalesce(ht_away, 0) AS ht_away, coalesce(corners_home, 0) AS corners_home, coalesce(yellows_away, 0) AS yellows_away, coalesce(reds_home, 0) AS reds_home, 'events' AS source
  FROM matches m LEFT JOIN (SELECT match_id, count(*) FILTER (side = 'HOME') AS ht_home, count(*) FILTER (side = 'AWAY') AS ht_away FROM raw WHERE kind = 'goal' AND period = 1 GROUP BY 1) h USING (match_id)
  LEFT JOIN (SELECT match_id, count(*) FILTER (type = 'corner' AND team = 'HOME') AS corners_home, count(*) FILTER (type = 'yellow_card' AND team = 'AWAY') AS yellows_away, count(*) FILTER (type = 'red_card' AND team = 'HOME') AS reds_home FROM norm GROUP BY 1) c USING (match_id)""", EM)
def s10(spark, d):
    return provider_events.match_facts(_raw(spark, d), _heads(spark, d), "events").select("match_id", "ht_home", "ht_away", "corners_home", "yellows_away", "reds_home", "source")


@query("a02_counters_from_raw", RAW + """ SELECT k::VARCHAR AS player_id, count(*) FILTER (name IN ('Pass', 'Shot')) AS actions, count(*) FILTER (name = 'Pass') AS passes, count(*) FILTER (name = 'Pass' AND k % 4 <> 1) AS passes_completed,
  count(*) FILTER (name = 'Pass' AND k % 4 <> 1 AND k <> 17 AND least(x * 1.2 + 20, 120) - x * 1.2 >= 15) AS progressive, count(*) FILTER (name = 'Shot' AND kind = 'goal') AS goals, count(DISTINCT match_id) AS matches
  FROM raw WHERE side IS NOT NULL AND period <> 5 GROUP BY k""", EM)
def a02_raw(spark, d):
    acts = provider_events.player_actions(_raw(spark, d), _heads(spark, d), "events").withColumn("competition", F.lit("c")).withColumn("season", F.lit("s"))
    return P.counters(acts).select("player_id", "actions", "passes", "passes_completed", "progressive", "goals", "matches")


# match detail --------------------------------------------------------------- #
def _details(spark, d):
    ev = match_events(spark, d)
    k, kind = F.col("k"), F.col("type")
    team = lambda i, n: F.struct(i.cast("bigint").alias("id"), n.alias("name"))
    n = F.col("match_no")
    home, away = team(n * 2, F.lit("Home")), team(n * 2 + 1, F.lit("Away"))
    side = F.when(F.col("team") == "HOME", home).otherwise(away)
    by_name = F.when(F.col("team") == "HOME", team(F.lit(None), F.lit("Home"))).otherwise(team(F.lit(None), F.lit("Away")))
    who = F.when(F.pmod(k, F.lit(3)) == 0, by_name).when(k == 50, team(F.lit(-1), F.lit("Other"))).otherwise(side)
    mi = F.when(k != 51, F.floor("minute").cast("int"))
    person = team(k, F.lit("P"))
    goal = F.array(F.struct(mi.alias("minute"), who.alias("team"), person.alias("scorer")))
    card = F.when(kind == "yellow_card", "YELLOW").when(k < 95, "YELLOW_RED").otherwise("RED")
    booking = F.array(F.struct(mi.alias("minute"), who.alias("team"), person.alias("player"), card.alias("card")))
    change = F.array(F.struct(mi.alias("minute"), who.alias("team"), person.alias("playerIn")))
    doc = F.struct(n.alias("id"), F.when(F.pmod("event_id", F.lit(4)) == 0, F.floor("minute").cast("int") + 1).alias("minute"), home.alias("homeTeam"), away.alias("awayTeam"),
                   F.when(kind == "goal", goal).alias("goals"), F.when(kind.isin("yellow_card", "red_card"), booking).alias("bookings"), F.when(kind == "foul", change).alias("substitutions"))
    return match_detail.parse_details(ev.where(kind.isin("goal", "yellow_card", "red_card", "foul")).select("event_id", F.to_json(doc).alias("json")))


@query("s05_match_detail_events", """ SELECT event_id, match_no::VARCHAR AS match_id, floor(minute)::DOUBLE AS minute, team, CASE WHEN type = 'foul' THEN 'substitution' ELSE type END AS type, k::VARCHAR AS player_id
  FROM match_events WHERE type IN ('goal', 'yellow_card', 'red_card', 'foul') AND k <> 51 AND NOT (k = 50 AND k % 3 <> 0)""", EV)
def s05(spark, d):
    return match_detail.events_from_details(_details(spark, d), ["event_id"])


@query("s21_live_clock", """ SELECT event_id, match_no::VARCHAR AS match_id, CASE WHEN event_id % 4 = 0 THEN floor(minute) + 1 WHEN k = 51 THEN 0 ELSE floor(minute) END::DOUBLE AS minute
  FROM match_events WHERE type IN ('goal', 'yellow_card', 'red_card', 'foul')""", EV)
def s21(spark, d):
    return match_detail.live_clock(_details(spark, d), ["event_id"])


# results -------------------------------------------------------------------- #
def _csv_rows(spark, d):
    fx = fixtures(spark, d)
    c = F.col("cents")
    text = lambda e: e.cast("string")
    return fx.select("seq", F.when(F.pmod(c, F.lit(3)) == 0, F.date_format("date", "dd/MM/yy")).otherwise(F.date_format("date", "dd/MM/yyyy")).alias("Date"),
                     F.col("home").alias("HomeTeam"), F.col("away").alias("AwayTeam"), F.when(F.pmod(c, F.lit(19)) == 0, "x").otherwise(text(F.col("home_goals"))).alias("FTHG"),
                     text(F.col("away_goals")).alias("FTAG"), *[text(F.pmod(c + i, F.lit(7))).alias(n) for i, n in enumerate(("HTHG", "HTAG", "HC", "AC", "HY", "AY", "HR", "AR"))])


@query("s06_results_csv_records", """ SELECT seq, 'csv' AS source, CASE WHEN cents % 3 = 0 AND year(date) < 2000 THEN date + INTERVAL 100 YEAR ELSE date END::DATE::VARCHAR AS date, home, away, home_goals::BIGINT AS home_goals, away_goals::BIGINT AS away_goals, """
       + ", ".join(f"(cents + {i}) % 7 AS {n}" for i, n in enumerate(("ht_home", "ht_away", "corners_home", "corners_away", "yellows_home", "yellows_away", "reds_home", "reds_away")))
       + " FROM fixtures WHERE cents % 19 <> 0", FX)
def s06(spark, d):
    return results.results_records(_csv_rows(spark, d), "csv")


def _community(spark, d):
    fx = fixtures(spark, d)
    c = F.col("cents")
    one = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("home").alias("team1"), F.col("away").alias("team2"), F.struct(
        F.when(F.pmod(c, F.lit(13)) != 0, F.array("home_goals", "away_goals")).alias("ft"), F.when(F.pmod(c, F.lit(2)) == 0, F.array(F.lit(0), F.lit(1))).alias("ht")).alias("score"))
    doc = F.struct(F.when(F.pmod("seq", F.lit(2)) == 0, F.array(one)).alias("matches"), F.when(F.pmod("seq", F.lit(2)) == 1, F.array(F.struct(F.array(one).alias("matches")))).alias("rounds"))
    parsed = fx.select("seq", F.from_json(F.to_json(doc), results.COMMUNITY_SCHEMA).alias("d")).select("seq", "d.*")
    return results.community_records(parsed, "community", ["seq"])


@query("s07_community_records", """ SELECT seq, 'community' AS source, date::VARCHAR AS date, home, away, home_goals::DOUBLE AS home_goals, away_goals::DOUBLE AS away_goals,
  CASE WHEN cents % 2 = 0 THEN 0 END::DOUBLE AS ht_home, CASE WHEN cents % 2 = 0 THEN 1 END::DOUBLE AS ht_away FROM fixtures WHERE cents % 13 <> 0""", FX)
def s07(spark, d):
    r = _community(spark, d)
    return r.select("seq", "source", "date", "home", "away", *[F.col(c).cast("double").alias(c) for c in ("home_goals", "away_goals", "ht_home", "ht_away")])


@query("s20_u02_all_providers", """ SELECT source, count(*) AS n, count(corners_home) AS with_corners, sum(home_goals)::BIGINT AS goals FROM (
  SELECT 'csv' AS source, cents AS corners_home, home_goals FROM fixtures WHERE cents % 19 <> 0 UNION ALL SELECT 'community', NULL, home_goals FROM fixtures WHERE cents % 13 <> 0) GROUP BY source""", FX)
def s20(spark, d):
    both = results.all_providers(results.results_records(_csv_rows(spark, d), "csv"), _community(spark, d))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("corners_home").alias("with_corners"), F.sum("home_goals").alias("goals"))


@query("s20_three_providers", RAW + """, facts AS (SELECT m.match_id, coalesce(count(*) FILTER (kind = 'goal' AND period = 1 AND side IS NOT NULL), 0) AS ht FROM matches m LEFT JOIN raw USING (match_id) GROUP BY 1)
SELECT 'csv' AS source, count(*) AS n, sum(home_goals)::BIGINT AS home_goals, NULL::BIGINT AS half_time_goals FROM fixtures WHERE cents % 19 <> 0 GROUP BY ALL
UNION ALL SELECT 'community', count(*), sum(home_goals)::BIGINT, count(*) FILTER (cents % 2 = 0) FROM fixtures WHERE cents % 13 <> 0 GROUP BY ALL
UNION ALL SELECT 'events', count(*), sum(home_goals_final)::BIGINT, (SELECT sum(ht) FROM facts)::BIGINT FROM matches""", ("match_events", "matches", "fixtures"))
def s20_three(spark, d):
    """Results files, community files and the records of the raw events as one table."""
    third = provider_events.match_records(_raw(spark, d), matches(spark, d), "events")
    every = results.all_providers(results.results_records(_csv_rows(spark, d), "csv"), _community(spark, d), third)
    return every.groupBy("source").agg(
        F.count("*").alias("n"), F.sum("home_goals").alias("home_goals"), F.sum(F.when(F.col("source") != "csv", F.col("ht_home") + F.col("ht_away"))).alias("half_time_goals"))


# open formats ---------------------------------------------------------------- #
def _open_rows(spark, d):
    ev = match_events(spark, d)
    m = F.pmod("event_id", F.lit(40))
    x = F.when(m == 0, "101").when(m == 1, "abc").when(m == 2, "").otherwise(F.round("x", 2).cast("string"))
    minute = F.when(m == 3, "late").when(m == 4, "151").when(m == 5, "0").otherwise(F.round("minute", 3).cast("string"))
    return ev.select("event_id", F.when(m != 6, F.col("match_id")).alias("match_id"), F.when(m == 7, "  ").otherwise("2024-01-01").alias("date"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"),
                     minute.alias("minute"), F.when(m == 8, "LEFT").when(m == 9, F.lower("team")).otherwise(F.col("team")).alias("team"), "type",
                     x.alias("x"), F.when(m == 10, "0").otherwise("50").alias("y"), F.col("player_id"))


OPEN = """
open_rows AS (SELECT event_id, match_id, minute, team, type, event_id % 40 AS m, x FROM match_events),
checked AS (SELECT *, CASE WHEN m = 6 THEN 'missing match_id' WHEN m = 7 THEN 'missing date' WHEN type = 'pass' THEN 'unknown type pass' WHEN m = 8 THEN 'unknown side LEFT' WHEN m = 3 THEN 'minute is not a number'
    WHEN m = 4 THEN 'minute outside 0-150' WHEN m = 0 THEN 'x outside 0-100' WHEN m = 1 THEN 'x is not a number' END AS reject_reason FROM open_rows)"""


@query("s08_validated_rows", OPEN + """ SELECT event_id, match_id, R(CASE WHEN m = 5 THEN 0 ELSE round(minute, 3) END) AS minute, team, type, R(CASE WHEN m = 2 THEN NULL ELSE round(x, 2) END) AS x FROM checked WHERE reject_reason IS NULL""", EV)
def s08(spark, d):
    return open_format.valid_rows(open_format.validate(_open_rows(spark, d))).select("event_id", "match_id", "minute", "team", "type", "x")


@query("s08_rejected_rows", OPEN + " SELECT event_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL", EV)
def s08_rejects(spark, d):
    return open_format.rejects(open_format.validate(_open_rows(spark, d))).select("event_id", "reject_reason")


@query("s13_custom_ingest", OPEN + """ SELECT match_id, count(*) FILTER (type = 'goal' AND team = 'HOME') AS home_goals_final, count(*) FILTER (type = 'goal' AND team = 'AWAY') AS away_goals_final, count(*) AS n_events
  FROM checked WHERE reject_reason IS NULL AND match_id NOT IN (SELECT match_id FROM matches WHERE match_no % 3 = 0) GROUP BY match_id""", EM)
def s13(spark, d):
    existing = matches(spark, d).where(F.pmod("match_no", F.lit(3)) == 0)
    return open_format.ingest(open_format.valid_rows(open_format.validate(_open_rows(spark, d))), existing).select("match_id", "home_goals_final", "away_goals_final", "n_events")


@query("s13_custom_replace", OPEN + """ SELECT match_id, count(*) FILTER (type = 'goal' AND team = 'HOME') AS home_goals_final, count(*) FILTER (type = 'goal' AND team = 'AWAY') AS away_goals_final, count(*) AS n_events, 'custom' AS origin
  FROM checked WHERE reject_reason IS NULL GROUP BY match_id
  UNION ALL SELECT match_id, home_goals_final, away_goals_final, NULL, 'stored' FROM matches WHERE match_id NOT IN (SELECT match_id FROM checked WHERE reject_reason IS NULL)""", EM)
def s13_replace(spark, d):
    """Stored headers, replaced where a custom file brings the match."""
    heads = matches(spark, d).select("match_id", "home_goals_final", "away_goals_final").withColumn("n_events", F.lit(None).cast("bigint")).withColumn("origin", F.lit("stored"))
    new = open_format.ingest(open_format.valid_rows(open_format.validate(_open_rows(spark, d))), heads, replace=True).withColumn("origin", F.lit("custom"))
    return tables.replace_keys(heads, new, ["match_id"])


def _tracking(spark, d):
    ev = match_events(spark, d)
    m = F.pmod("event_id", F.lit(25))
    return ev.select("event_id", "match_id", F.when(m == 0, "?").otherwise(F.round(F.col("minute") * 60, 2).cast("string")).alias("t"), F.when(m != 1, F.col("player_id")).alias("player_id"), "team",
                     F.col("x").cast("string").alias("x"), F.when(m == 2, "").otherwise(F.col("y").cast("string")).alias("y"), F.when(m == 3, "").otherwise(F.concat(F.lit("José "), "player_id")).alias("player"))


@query("s09_tracking_frames", """ SELECT event_id, R(round(minute * 60, 2)) AS t, player_id, team, R(x) AS x, R(y) AS y, CASE WHEN event_id % 25 <> 3 THEN 'José ' || player_id END AS player FROM match_events WHERE event_id % 25 > 2""", EV)
def s09(spark, d):
    return open_format.frames(_tracking(spark, d), ["event_id"])


@query("s09_position_records", """ SELECT 'position' AS kind, match_id, 'player_' || substr(sha256('name:' || CASE WHEN event_id % 25 = 3 THEN player_id ELSE 'jose ' || player_id END), 1, 16) AS player_id, team, R(round(minute * 60, 2)) AS second
  FROM match_events WHERE event_id % 25 > 2""", EV)
def s09_records(spark, d):
    f = open_format.frames(_tracking(spark, d), ["match_id"])
    return open_format.position_records(f, F.col("match_id"), "tracking").select("kind", "match_id", "player_id", "team", "second")


# entities -------------------------------------------------------------------- #
@query("s11_s12_entity_bios", """ SELECT name, qid, birth_date::VARCHAR AS birth_date, height_cm::DOUBLE AS height_cm, citizenship, position_name FROM (SELECT p.p_brand AS name, 'Q' || p_partkey AS qid, DATE '1980-01-01' + (p_partkey % 8000)::INTEGER AS birth_date,
    CASE WHEN p_partkey % 2 = 0 THEN 150 + p_size ELSE round_even((1.5 + p_size / 100.0) * 100, 0) END AS height_cm, coalesce(n_name, 'N' || (p_partkey % 30)) AS citizenship, 'N' || (p_partkey % 3 + 100) AS position_name,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, 'Q' || p_partkey) AS rk FROM part p LEFT JOIN nation n ON n.n_nationkey = p_partkey % 30 WHERE p_partkey % 4 <> 0) WHERE rk = 1""")
def s11(spark, d):
    p = load(spark, d, "part")
    n = F.col("p_partkey")
    qid = F.concat(F.lit("Q"), n.cast("string"))
    hits = p.select(F.col("p_brand").alias("name"), F.col("p_retailprice").alias("rank"), qid.alias("qid"))
    born = F.date_add(F.lit("1980-01-01").cast("date"), F.pmod(n, F.lit(8000)).cast("int"))
    job = F.when(F.pmod(n, F.lit(4)) != 0, F.array(F.lit("Q1"), F.lit(entities.FOOTBALLER))).otherwise(F.array(F.lit("Q1")))
    tall = F.when(F.pmod(n, F.lit(2)) == 0, (150 + F.col("p_size")).cast("string")).otherwise((1.5 + F.col("p_size") / 100.0).cast("string"))
    ent = p.select(qid.alias("qid"), job.alias("occupations"), F.concat(F.lit("+"), born.cast("string"), F.lit("T00:00:00Z")).alias("birth"), tall.alias("height"),
                   F.concat(F.lit("N"), (F.pmod(n, F.lit(3)) + 100).cast("string")).alias("position"), F.concat(F.lit("N"), F.pmod(n, F.lit(30)).cast("string")).alias("country"))
    labels = load(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("qid"), F.col("n_name").alias("label"))
    return entities.bios(hits, ent, labels).withColumn("height_cm", F.col("height_cm").cast("double"))


# sinks ------------------------------------------------------------------------ #
@query("s14_partition_overwrite", """ SELECT m.competition, count(*) AS n, R(max(e.minute) * CASE WHEN m.competition = 'C1' THEN 2 ELSE 1 END) AS last_minute FROM match_events e JOIN matches m USING (match_id) GROUP BY m.competition""", EM)
def s14(spark, d):
    path = new_folder(spark, "events-table")
    ev = match_events(spark, d).join(matches(spark, d).select("match_id", "competition"), "match_id").select("competition", "match_id", "event_id", "minute")
    tables.write_partitions(ev, path, ["competition"])
    changed = ev.where("competition = 'C1'").withColumn("minute", F.col("minute") * 2)
    tables.write_partitions(changed, path, ["competition"])
    tables.write_partitions(changed, path, ["competition"])
    return spark.read.parquet(path).groupBy("competition").agg(F.count("*").alias("n"), F.max("minute").alias("last_minute"))


@query("s14_replace_one_match", """ SELECT e.match_id, CASE WHEN m.match_no % 10 = 3 THEN 'moved' ELSE m.competition END AS competition, count(*) AS n, R(max(e.minute * CASE WHEN m.match_no % 10 IN (3, 7) THEN 2 ELSE 1 END)) AS last_minute
  FROM match_events e JOIN matches m USING (match_id) GROUP BY ALL""", EM)
def s14_match(spark, d):
    """Some matches of each competition come again, some of them under another one; all others keep their rows."""
    path = new_folder(spark, "match-table")
    ev = match_events(spark, d).join(matches(spark, d).select("match_id", "competition"), "match_id").select("competition", "match_id", "match_no", "event_id", "minute")
    versions.replace_matches(ev, path, ["competition"], buckets=8)
    last = F.pmod("match_no", F.lit(10))
    again = ev.where(last.isin(3, 7)).withColumn("minute", F.col("minute") * 2).withColumn("competition", F.when(last == 3, "moved").otherwise(F.col("competition")))
    versions.replace_matches(again, path, ["competition"], buckets=8)
    return versions.read(spark, path, ["competition"]).groupBy("match_id", "competition").agg(F.count("*").alias("n"), F.max("minute").alias("last_minute"))


@query("s15_refresh_audit", """ SELECT competition, season, count(*) FILTER (match_no % 4 <> 0) AS matches_added, count(*) FILTER (match_no % 4 = 0) AS matches_skipped,
  count(*) FILTER (match_no % 4 <> 0 AND bad) AS issues, (count(*) FILTER (match_no % 4 <> 0 AND bad) = 0)::BIGINT AS quality_ok
  FROM (SELECT *, match_no % 25 = 0 AS bad FROM matches) GROUP BY ALL""", EM)
def s15(spark, d):
    m = matches(spark, d)
    issues = M.quality_issues(m, M.match_facts(match_events(spark, d)))
    return tables.refresh_audit(m, m.where(F.pmod("match_no", F.lit(4)) == 0), issues, ["competition", "season"])


@query("s16_replace_by_key", """ SELECT match_id, event_id, type FROM match_events WHERE match_no % 2 = 0 UNION ALL SELECT match_id, event_id, 'new' FROM match_events WHERE match_no % 2 = 1 AND type = 'goal'
  UNION ALL SELECT match_id, event_id, type FROM match_events WHERE match_no % 2 = 1 AND match_id NOT IN (SELECT match_id FROM match_events WHERE type = 'goal')""", EV)
def s16(spark, d):
    ev = match_events(spark, d)
    cols = ["match_id", "event_id", "type"]
    new = ev.where((F.pmod("match_no", F.lit(2)) == 1) & (F.col("type") == "goal")).select("match_id", "event_id", F.lit("new").alias("type"))
    return tables.replace_keys(ev.select(*cols), new, ["match_id"])


@query("s17_j01_scored_pairs", """ SELECT event_id AS prediction_id, R(x / 100) AS prob, (y > 50)::BIGINT AS happened FROM match_events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""", EV)
def s17(spark, d):
    ev = match_events(spark, d).withColumnRenamed("event_id", "prediction_id")
    made = ev.where(F.pmod("prediction_id", F.lit(5)) != 0).select("prediction_id", (F.col("x") / 100).alias("prob"))
    known = ev.where(F.pmod("prediction_id", F.lit(7)) != 0).select("prediction_id", (F.col("y") > 50).alias("happened"))
    return tables.scored_pairs(made, known)


@query("s22_materialise_missing", RAW + """ SELECT match_id, count(*) AS n FROM raw WHERE name IN ('Pass', 'Shot', 'Foul Committed') AND k <> 17 GROUP BY match_id""", EM)
def s22(spark, d):
    """Ball streams of some matches exist; only the missing ones are added."""
    path = new_folder(spark, "ball-stream")
    stream = provider_events.ball_stream(_raw(spark, d), _heads(spark, d))
    done = F.pmod(F.crc32("match_id"), F.lit(3)) == 0
    stream.where(done).write.parquet(path)
    stored = spark.read.parquet(path)
    todo = tables.missing_only(stream, stored, ["match_id"])
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("match_id").agg(F.count("*").alias("n"))


@query("s22_rebuild_networks", RAW + """ SELECT match_id, team_name AS team, k::VARCHAR AS src, (k + 1)::VARCHAR AS dst, count(*) AS passes, 'v2' AS built_by
  FROM raw WHERE name = 'Pass' AND k % 4 NOT IN (0, 1) GROUP BY ALL""", EM)
def s22_networks(spark, d):
    """Networks derived by an older code, some from rows that have changed since: stale matches are derived again, then nothing is stale."""
    path = new_folder(spark, "networks")
    passes = cut(provider_events.pass_records(_raw(spark, d)).where("success"))

    def derive(marks, code):
        todo = passes.join(marks, "match_id")
        return todo.groupBy("match_id", "fingerprint", "team", "src", "dst").agg(F.count("*").alias("passes")).withColumn("built_by", F.lit(code))

    fields = [F.col(c) for c in ("event_no", "team", "src", "dst")]
    versions.replace_matches(derive(versions.fingerprints(passes, fields, "v1"), "v1"), path, [], buckets=8)
    now = cut(versions.fingerprints(passes, fields, "v2"))
    for half in (F.pmod(F.crc32("match_id"), F.lit(2)) == 0, F.lit(True)):  # the first run is cut short
        todo = versions.stale(now, versions.read(spark, path, [])).where(half)
        versions.replace_matches(derive(todo, "v2"), path, [], buckets=8)
    return versions.read(spark, path, []).drop("fingerprint")


@query("g03_provider_interface", " SELECT source, count(*) AS n FROM (SELECT 'csv' AS source FROM fixtures WHERE cents % 19 <> 0 UNION ALL SELECT 'community' FROM fixtures WHERE cents % 13 <> 0) GROUP BY source", FX)
def g03(spark, d):
    registry = results.ProviderRegistry()
    registry.add("csv", 0.9, lambda: results.results_records(_csv_rows(spark, d), "csv"))
    registry.add("community", 0.8, lambda: _community(spark, d))
    return registry.records().groupBy("source").agg(F.count("*").alias("n"))
