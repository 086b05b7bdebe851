"""Canonical tables derived from the generic star schema, in Spark and in SQL.

Each ``spark_*`` function has a SQL twin in ``SQL``; both are plain projections and
aggregates, so the queries built on them read the whole given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.clock import naive_micros

START = "2024-01-01 00:00:00"
START_MICROS = 1_704_067_200_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as its files are laid out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(a, b) -> Column:
    return F.pmod(a, F.lit(b))


def _div(a: str, b: int) -> Column:
    return F.expr(f"cast(floor({a} / {b}) as bigint)")


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match per user, the 30-day window mapped to a 95-minute clock."""
    ev = load(spark, sf_dir, "events")
    v = F.round(F.col("value") * 100).cast("bigint")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    micros = naive_micros(F.col("ts")) - F.lit(START_MICROS)
    minute = micros / F.lit(1e6) / F.lit(2592000.0) * F.lit(95.0)
    kind = (
        F.when(F.col("event_type") == "view", "shot").when(F.col("event_type") == "click", "shot_on_target")
        .when(F.col("event_type") == "signup", "corner")
        .when((F.col("event_type") == "purchase") & (F.col("value") >= 75), "goal")
        .when(F.col("event_type") == "purchase", "pass")
        .when(k < 60, "foul").when(k < 90, "yellow_card").otherwise("red_card"))
    return ev.select(
        "event_id", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("match_id"),
        F.col("user_id").alias("match_no"), minute.alias("minute"),
        F.when(_mod(F.col("event_id"), 2) == 0, "HOME").otherwise("AWAY").alias("team"),
        kind.alias("type"), F.concat(F.lit("p"), k.cast("string")).alias("player_id"), k.alias("k"),
        (_mod(v * 37, 10001) / 100.0).alias("x"), (_mod(v * 53, 10001) / 100.0).alias("y"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match headers; every 25th match carries a wrong final score on purpose."""
    ev = match_events(spark, sf_dir)
    n = F.col("match_no")
    return ev.groupBy("match_id", "match_no").agg(
        F.max("minute").alias("last_minute"),
        F.count_if((F.col("type") == "goal") & (F.col("team") == "HOME")).alias("home_goal_events"),
        F.count_if((F.col("type") == "goal") & (F.col("team") == "AWAY")).alias("away_goal_events"),
    ).select(
        "match_id", "match_no", F.concat(F.lit("C"), _mod(n, 5).cast("string")).alias("competition"),
        F.concat(F.lit("S"), _mod(_div("match_no", 5), 3).cast("string")).alias("season"),
        F.date_add(F.lit("2023-08-01").cast("date"), _mod(n * 3, 300).cast("int")).alias("match_date"),
        F.concat(F.lit("Team "), _mod(n, 18).cast("string")).alias("home_team"),
        F.concat(F.lit("Team "), _mod(_mod(n, 18) + 1 + _mod(_div("match_no", 18), 17), 18).cast("string")).alias("away_team"),
        (F.floor("last_minute") + 1).cast("int").alias("duration"),
        (F.col("home_goal_events") + F.when(_mod(n, 25) == 0, 1).otherwise(0)).alias("home_goals_final"),
        F.col("away_goal_events").alias("away_goals_final"))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League results: small leagues whose number grows with the customer table."""
    o = load(spark, sf_dir, "orders")
    c = F.round(F.col("o_totalprice") * 100).cast("bigint")
    home = _mod(F.col("o_orderkey"), 12)
    away = _mod(home + 1 + _mod(F.col("o_custkey"), 11), 12)
    o = o.withColumn("cents", c)
    date = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("L"), _div("o_custkey", 50).cast("string")).alias("league"),
        F.year(date).cast("string").alias("season"), date.alias("date"),
        F.concat(F.lit("T"), home.cast("string")).alias("home"),
        F.concat(F.lit("T"), away.cast("string")).alias("away"),
        F.least(_mod(F.col("cents"), 5), _mod(_div("cents", 5), 4)).cast("int").alias("home_goals"),
        F.least(_mod(_div("cents", 20), 4), _mod(_div("cents", 80), 4)).cast("int").alias("away_goals"),
        (F.lit(1.2) + _mod(F.col("cents"), 300) / 100.0).alias("odds_h"),
        (F.lit(2.5) + _mod(_div("cents", 300), 200) / 100.0).alias("odds_d"),
        (F.lit(1.3) + _mod(_div("cents", 60000), 400) / 100.0).alias("odds_a"),
        "cents")


def provider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers reporting the fixtures under different spellings."""
    fx = fixtures(spark, sf_dir)
    c = F.col("cents")
    stats = {
        "home_goals": F.col("home_goals"), "away_goals": F.col("away_goals"),
        "ht_home": F.least("home_goals", _mod(c, 2)).cast("int"), "ht_away": F.least("away_goals", _mod(c, 3)).cast("int"),
        "corners_home": _mod(c, 9).cast("int"), "corners_away": _mod(_div("cents", 9), 9).cast("int"),
        "yellows_home": _mod(c, 4).cast("int"), "yellows_away": _mod(_div("cents", 4), 5).cast("int"),
        "reds_home": F.when(_mod(c, 13) == 0, 1).otherwise(0), "reds_away": F.when(_mod(c, 17) == 0, 1).otherwise(0),
    }
    base = fx.select("seq", F.col("date"), "league", "home", "away", "cents", *[e.alias(n) for n, e in stats.items()])
    def team(name, fmt):
        return F.format_string(fmt, F.col("league"), F.col(name))
    def record(source, fmt, values):
        return F.struct(F.lit(source).alias("source"), "seq", "date", "league", "cents", team("home", fmt).alias("home"), team("away", fmt).alias("away"), *values)
    off = lambda i, every: F.when(_mod(c + i, every) == 0, 1).otherwise(0)
    alpha = record("alpha", "Atlético %s %s FC", [F.col(n).cast("int").alias(n) for n in stats])
    beta = record("beta", "CF ATLETICO %s-%s 1907", [(F.col(n) + off(i, 17)).cast("int").alias(n) for i, n in enumerate(stats)])
    gamma = record("gamma", "Atlètico %s.%s", [F.when(_mod(c + i, 5) != 0, F.col(n) + off(i, 11)).cast("int").alias(n) for i, n in enumerate(stats)])
    told = F.array_compact(F.array(alpha, F.when(_mod(F.col("seq"), 4) != 0, beta), F.when(_mod(F.col("seq"), 3) != 0, gamma)))
    return base.select(F.explode(told).alias("r")).select("r.*")


def player_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-ball actions: the kind comes from the line number, flags from the measures."""
    li = load(spark, sf_dir, "lineitem")
    kinds = ["Pass", "Pass", "Pass", "Carry", "Shot", "Dribble", "Miscontrol"]
    action = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("l_linenumber"))
    return li.select(
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("player_id"),
        F.concat(F.lit("Player "), F.col("l_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("T"), _mod(F.col("l_suppkey"), 12).cast("string")).alias("team"),
        F.element_at(F.array(*[F.lit(p) for p in ("GK", "DF", "MF", "FW")]), (_mod(F.col("l_suppkey"), 4) + 1).cast("int")).alias("position"),
        F.concat(F.lit("C"), _mod(F.col("l_partkey"), 5).cast("string")).alias("competition"),
        F.year(F.col("l_shipdate").cast("date")).cast("string").alias("season"),
        F.col("l_orderkey").alias("match_id"),
        F.when(_mod(F.col("l_partkey"), 2) == 0, "alpha").otherwise("beta").alias("source"),
        action.alias("action"), (F.col("l_returnflag") != "R").alias("completed"),
        (F.col("l_quantity") * 2.0).alias("advance"), (F.col("l_discount") >= 0.09).alias("shot_assist"),
        (F.col("l_quantity") >= 50).alias("goal_assist"),
        ((F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 40)).alias("scored"),
        (F.col("l_linestatus") == "F").alias("won"))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed passes inside a (match, side) scope."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("f"), _div("l_orderkey", 40).cast("string")).alias("match_id"),
        F.when(F.col("l_linestatus") == "O", "HOME").otherwise("AWAY").alias("side"),
        F.concat(F.lit("p"), _mod(F.col("l_suppkey"), 15).cast("string")).alias("src"),
        F.when(_mod(F.col("l_partkey"), 31) != 0, F.concat(F.lit("p"), _mod(F.col("l_partkey"), 15).cast("string"))).alias("dst"),
        (F.col("l_returnflag") != "R").alias("success"), (F.col("l_quantity") >= 45).alias("chance"))


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned facts about players, one per order, arriving in order-key sequence."""
    o = load(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    key, c = F.col("o_orderkey"), F.col("cents")
    date = F.col("o_orderdate").cast("date")
    layers = F.array(*[F.lit(x) for x in (
        "observed", "historical", "youth", "external", "derived", "probabilistic", "simulated", "experimental")])
    temporary = _mod(key, 5) == 0
    layer = F.element_at(layers, (_mod(_div("o_orderkey", 3), 8) + 1).cast("int"))
    d = o.select(
        key.alias("seq"), F.col("o_orderpriority").alias("kind"), layer.alias("layer"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("player_id"),
        F.when(_mod(key, 3) != 1, F.concat(F.lit("T"), _mod(F.col("o_custkey") + F.when(_mod(key, 50) == 7, 1).otherwise(0), 12).cast("string"))).alias("team"),
        F.when(_mod(key, 4) != 0, F.concat(F.lit("f"), _div("o_orderkey", 6).cast("string"))).alias("match_id"),
        F.concat(F.lit("C"), _mod(F.col("o_custkey"), 5).cast("string")).alias("competition"),
        F.year(date).cast("string").alias("season"),
        F.when(_mod(key, 6) == 2, (_mod(c, 9500) / 100.0)).alias("minute"),
        F.concat(F.col("o_orderstatus"), _mod(c, 10).cast("string")).alias("value"),
        F.when(_mod(key, 97) != 5, F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (_mod(key, 3) + 1).cast("int"))).alias("source"),
        F.date_add(date, _mod(key, 40).cast("int")).alias("collected_at"),
        F.when(_mod(key, 7) != 0, F.concat(F.lit("rec"), _div("o_orderkey", 2).cast("string"))).alias("parent"),
        F.when(_mod(key, 21) == 0, F.lit("v1")).alias("pipeline_version"),
        F.when(_mod(key, 29) != 3, date).alias("valid_from"),
        F.when(temporary, F.date_add(date, 30)).when(_mod(key, 11) == 0, F.date_add(date, 60)).alias("valid_to"),
        F.when(temporary, "temporary").otherwise("permanent").alias("permanence"),
        F.when(_mod(key, 13) != 0, _mod(c, 100) / 100.0).alias("confidence"))
    from pitchgrid.functions.text import content_id
    return d.withColumn("id", content_id(*[F.col(x) for x in ("seq", "kind", "layer", "player_id", "value", "source")]))


SQL = {
    "match_events": f"""
match_events AS (
  SELECT event_id, 'm' || user_id AS match_id, user_id AS match_no,
    date_diff('microsecond', TIMESTAMP '{START}', ts)::DOUBLE / 1e6::DOUBLE / 2592000.0::DOUBLE * 95.0::DOUBLE AS minute,
    CASE WHEN event_id % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS team,
    CASE WHEN event_type = 'view' THEN 'shot' WHEN event_type = 'click' THEN 'shot_on_target'
         WHEN event_type = 'signup' THEN 'corner'
         WHEN event_type = 'purchase' AND value >= 75 THEN 'goal' WHEN event_type = 'purchase' THEN 'pass'
         WHEN k < 60 THEN 'foul' WHEN k < 90 THEN 'yellow_card' ELSE 'red_card' END AS type,
    'p' || k AS player_id, k,
    (v * 37 % 10001)::DOUBLE / 100.0::DOUBLE AS x, (v * 53 % 10001)::DOUBLE / 100.0::DOUBLE AS y
  FROM (SELECT *, round(value * 100)::BIGINT AS v, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events))""",
    "matches": """
matches AS (
  SELECT match_id, match_no, 'C' || (match_no % 5) AS competition, 'S' || ((match_no // 5) % 3) AS season,
    DATE '2023-08-01' + (match_no * 3 % 300)::INTEGER AS match_date,
    'Team ' || (match_no % 18) AS home_team,
    'Team ' || ((match_no % 18 + 1 + (match_no // 18) % 17) % 18) AS away_team,
    (floor(last_minute) + 1)::INTEGER AS duration,
    home_goal_events + CASE WHEN match_no % 25 = 0 THEN 1 ELSE 0 END AS home_goals_final,
    away_goal_events AS away_goals_final
  FROM (SELECT match_id, match_no, max(minute) AS last_minute,
          count(*) FILTER (type = 'goal' AND team = 'HOME') AS home_goal_events,
          count(*) FILTER (type = 'goal' AND team = 'AWAY') AS away_goal_events
        FROM match_events GROUP BY ALL))""",
    "fixtures": """
fixtures AS (
  SELECT o_orderkey AS seq, 'L' || (o_custkey // 50) AS league, year(o_orderdate)::VARCHAR AS season,
    o_orderdate::DATE AS date, 'T' || (o_orderkey % 12) AS home,
    'T' || ((o_orderkey % 12 + 1 + o_custkey % 11) % 12) AS away,
    least(cents % 5, (cents // 5) % 4)::INTEGER AS home_goals,
    least((cents // 20) % 4, (cents // 80) % 4)::INTEGER AS away_goals,
    1.2::DOUBLE + (cents % 300)::DOUBLE / 100.0::DOUBLE AS odds_h,
    2.5::DOUBLE + ((cents // 300) % 200)::DOUBLE / 100.0::DOUBLE AS odds_d,
    1.3::DOUBLE + ((cents // 60000) % 400)::DOUBLE / 100.0::DOUBLE AS odds_a, cents
  FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders))""",
    "player_actions": """
player_actions AS (
  SELECT 'p' || l_suppkey AS player_id, 'Player ' || l_suppkey AS name, 'T' || (l_suppkey % 12) AS team,
    (['GK','DF','MF','FW'])[(l_suppkey % 4 + 1)::INTEGER] AS position, 'C' || (l_partkey % 5) AS competition,
    year(l_shipdate)::VARCHAR AS season, l_orderkey AS match_id,
    CASE WHEN l_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source,
    (['Pass','Pass','Pass','Carry','Shot','Dribble','Miscontrol'])[l_linenumber] AS action,
    l_returnflag <> 'R' AS completed, l_quantity * 2.0 AS advance, l_discount >= 0.09 AS shot_assist,
    l_quantity >= 50 AS goal_assist, l_linestatus = 'O' AND l_quantity >= 40 AS scored, l_linestatus = 'F' AS won
  FROM lineitem)""",
    "passes": """
passes AS (
  SELECT 'f' || (l_orderkey // 40) AS match_id, CASE WHEN l_linestatus = 'O' THEN 'HOME' ELSE 'AWAY' END AS side,
    'p' || (l_suppkey % 15) AS src, CASE WHEN l_partkey % 31 <> 0 THEN 'p' || (l_partkey % 15) END AS dst,
    l_returnflag <> 'R' AS success, l_quantity >= 45 AS chance
  FROM lineitem)""",
    "knowledge": """
knowledge AS (
  SELECT *, substr(sha256(to_json([seq::VARCHAR, kind, layer, player_id, value, source])::VARCHAR), 1, 16) AS id
  FROM (SELECT o_orderkey AS seq, o_orderpriority AS kind,
    (['observed','historical','youth','external','derived','probabilistic','simulated','experimental'])[((o_orderkey // 3) % 8 + 1)::INTEGER] AS layer,
    'p' || o_custkey AS player_id,
    CASE WHEN o_orderkey % 3 <> 1 THEN 'T' || ((o_custkey + CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END) % 12) END AS team,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'f' || (o_orderkey // 6) END AS match_id,
    'C' || (o_custkey % 5) AS competition, year(o_orderdate)::VARCHAR AS season,
    CASE WHEN o_orderkey % 6 = 2 THEN (cents % 9500)::DOUBLE / 100.0::DOUBLE END AS minute,
    o_orderstatus || (cents % 10) AS value,
    CASE WHEN o_orderkey % 97 <> 5 THEN (['alpha','beta','gamma'])[(o_orderkey % 3 + 1)::INTEGER] END AS source,
    o_orderdate::DATE + (o_orderkey % 40)::INTEGER AS collected_at,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'rec' || (o_orderkey // 2) END AS parent,
    CASE WHEN o_orderkey % 21 = 0 THEN 'v1' END AS pipeline_version,
    CASE WHEN o_orderkey % 29 <> 3 THEN o_orderdate::DATE END AS valid_from,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 30 WHEN o_orderkey % 11 = 0 THEN o_orderdate::DATE + 60 END AS valid_to,
    CASE WHEN o_orderkey % 5 = 0 THEN 'temporary' ELSE 'permanent' END AS permanence,
    CASE WHEN o_orderkey % 13 <> 0 THEN (cents % 100)::DOUBLE / 100.0::DOUBLE END AS confidence
  FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders)))""",
}
_stats = {
    "home_goals": "home_goals", "away_goals": "away_goals",
    "ht_home": "least(home_goals, cents % 2)::INTEGER", "ht_away": "least(away_goals, cents % 3)::INTEGER",
    "corners_home": "(cents % 9)::INTEGER", "corners_away": "((cents // 9) % 9)::INTEGER",
    "yellows_home": "(cents % 4)::INTEGER", "yellows_away": "((cents // 4) % 5)::INTEGER",
    "reds_home": "CASE WHEN cents % 13 = 0 THEN 1 ELSE 0 END", "reds_away": "CASE WHEN cents % 17 = 0 THEN 1 ELSE 0 END",
}
_exact = ", ".join(f"{e} AS {n}" for n, e in _stats.items())
_beta = ", ".join(
    f"({n} + CASE WHEN (cents + {i}) % 17 = 0 THEN 1 ELSE 0 END)::INTEGER AS {n}" for i, n in enumerate(_stats))
_gamma = ", ".join(
    f"CASE WHEN (cents + {i}) % 5 <> 0 THEN {n} + CASE WHEN (cents + {i}) % 11 = 0 THEN 1 ELSE 0 END END::INTEGER AS {n}"
    for i, n in enumerate(_stats))
SQL["provider_records"] = f"""
provider_base AS (SELECT seq, date, league, home, away, cents, {_exact} FROM fixtures),
provider_records AS (
  SELECT 'alpha' AS source, seq, date, league, cents, 'Atlético ' || league || ' ' || home || ' FC' AS home,
    'Atlético ' || league || ' ' || away || ' FC' AS away, {", ".join(_stats)} FROM provider_base
  UNION ALL BY NAME
  SELECT 'beta' AS source, seq, date, league, cents, 'CF ATLETICO ' || league || '-' || home || ' 1907' AS home,
    'CF ATLETICO ' || league || '-' || away || ' 1907' AS away, {_beta} FROM provider_base WHERE seq % 4 <> 0
  UNION ALL BY NAME
  SELECT 'gamma' AS source, seq, date, league, cents, 'Atlètico ' || league || '.' || home AS home,
    'Atlètico ' || league || '.' || away AS away, {_gamma} FROM provider_base WHERE seq % 3 <> 0)"""
REQUIRES = {"matches": ["match_events"], "provider_records": ["fixtures"]}


def with_tables(sql: str, *names: str) -> str:
    """Prefix ``sql`` (a SELECT, or 'name AS (..), .. SELECT') with the named tables."""
    order: list[str] = []
    def add(n):
        for r in REQUIRES.get(n, []):
            add(r)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    body = ",".join(SQL[n] for n in order)
    text = sql.strip()
    glue = "" if text.upper().startswith("SELECT") or text.startswith("(") else ","
    return f"WITH RECURSIVE {body}{glue}\n{text}"
