"""Queries: entity keys, provider fusion, reliability, clock alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import fixtures, match_events, provider_records
from pitchgrid.functions import text as X
from pitchgrid.plans import fusion as U
from pitchgrid.settings import FUSED_FIELDS, STRUCTURAL_TOKENS
from pitchgrid.shared import cut

PRIORS = {"alpha": 0.95, "beta": 0.90, "gamma": 0.80}
PR = ("provider_records",)

_NOISE = ", ".join(f"'{t}'" for t in STRUCTURAL_TOKENS)


def key_sql(col: str) -> str:
    clean = f"translate(lower(strip_accents({col})), '.-', '  ')"
    return (f"array_to_string(list_filter(regexp_split_to_array({clean}, '\\s+'), "
            f"lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_NOISE})), ' ')")


ALIAS_SQL = "CASE {k} WHEN 'atletico l0 t0' THEN 'athletic l0 t0' ELSE {k} END"
_F = ", ".join(FUSED_FIELDS)
RESOLVED = f"""
names AS MATERIALIZED (SELECT name, {ALIAS_SQL.format(k='k')} AS key FROM (SELECT name, {key_sql('name')} AS k FROM (SELECT home AS name FROM provider_records UNION SELECT away FROM provider_records))),
keyed AS (SELECT source, seq, date, league, h.key AS home_key, a.key AS away_key, {_F}
  FROM provider_records p JOIN names h ON h.name = p.home JOIN names a ON a.name = p.away),
resolved AS MATERIALIZED (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY date, home_key, away_key, source ORDER BY seq DESC) = 1),
facts AS MATERIALIZED (UNPIVOT (SELECT date, home_key, away_key, source, {', '.join(f'{f}::DOUBLE AS {f}' for f in FUSED_FIELDS)} FROM resolved) ON {_F} INTO NAME field VALUE value)"""


def cells_sql(a="0.95", b="0.90", g="0.80", suffix="") -> str:
    prior = f"CASE source WHEN 'alpha' THEN {a} WHEN 'beta' THEN {b} ELSE {g} END::DOUBLE"
    return f"""
clusters{suffix} AS (SELECT date, home_key, away_key, field, value, sum({prior} ORDER BY source) AS weight, max({prior}) AS top,
    list(source ORDER BY source) AS sources FROM facts GROUP BY ALL),
cells{suffix} AS MATERIALIZED (SELECT date, home_key, away_key, field, value, weight / sum(weight) OVER w AS confidence,
    count(*) OVER w = 1 AS agreed, sources, sum(len(sources)) OVER w AS n_claims
  FROM clusters{suffix}
  WINDOW w AS (PARTITION BY date, home_key, away_key, field)
  QUALIFY row_number() OVER (PARTITION BY date, home_key, away_key, field ORDER BY weight DESC, top DESC, sources DESC) = 1)"""


CELLS = RESOLVED + "," + cells_sql()


def _aliases(spark):
    return spark.createDataFrame([("atletico l0 t0", "athletic l0 t0")], "alias string, canonical string")


def _resolved(spark, d):
    return U.resolve(provider_records(spark, d), _aliases(spark))


def _cells(spark, d, priors=None):
    return U.fuse(_resolved(spark, d), PRIORS if priors is None else priors)


@query("f01_entity_keys", f" SELECT source, seq, {key_sql('home')} AS home_key, {key_sql('away')} AS away_key FROM provider_records", PR)
def f01(spark, d):
    return provider_records(spark, d).select("source", "seq", X.entity_key(F.col("home")).alias("home_key"),
                                             X.entity_key(F.col("away")).alias("away_key"))


@query("f01_fold_accents_exact", " SELECT source, seq, lower(strip_accents(home)) AS folded FROM provider_records", PR)
def f01_exact(spark, d):
    return provider_records(spark, d).select("source", "seq", F.lower(X.fold_accents_exact(F.col("home"))).alias("folded"))


PERSON_SQL = "trim(regexp_replace(lower(strip_accents(translate(home, '.-', '  '))), ' +', ' ', 'g'))"


@query("f02_canonical_ids", f""" SELECT source, seq, 'team_' || substr(sha256({key_sql('home')}), 1, 16) AS home_team_id,
  'player_' || substr(sha256(CASE WHEN seq % 3 = 0 THEN 'ext:Q' || seq WHEN seq % 3 = 1 THEN {PERSON_SQL} || '|' || date ELSE 'name:' || {PERSON_SQL} END), 1, 16) AS player_id
  FROM provider_records""", PR)
def f02(spark, d):
    m = F.pmod("seq", F.lit(3))
    return provider_records(spark, d).select(
        "source", "seq", X.prefixed_id("team", X.entity_key(F.col("home"))).alias("home_team_id"),
        X.player_id(F.col("home"), F.when(m == 1, F.col("date")), F.when(m == 0, F.concat(F.lit("Q"), F.col("seq").cast("string")))).alias("player_id"))


@query("j02_resolved_fixtures", RESOLVED + """ SELECT date::VARCHAR AS date, home_key, away_key, count(*) AS n_sources,
  string_agg(source, '|' ORDER BY source) AS sources FROM resolved GROUP BY ALL""", PR)
def j02(spark, d):
    return U.fixtures_seen(_resolved(spark, d))


@query("x01_fused_fields", CELLS + """ SELECT date::VARCHAR AS date, home_key, away_key, field, R(value) AS value,
  R(confidence) AS confidence, agreed::BIGINT AS agreed, array_to_string(sources, '|') AS sources, n_claims::BIGINT AS n_claims FROM cells""", PR)
def x01(spark, d):
    return _cells(spark, d).where("n_claims > 0").drop("dissent")


@query("x01_dissent", CELLS + """ SELECT f.date::VARCHAR AS date, f.home_key, f.away_key, f.field, f.source, R(f.value) AS value
  FROM facts f JOIN cells c USING (date, home_key, away_key, field) WHERE NOT list_contains(c.sources, f.source)""", PR)
def x01_dissent(spark, d):
    return _cells(spark, d).select(*U.FIXTURE, "field", F.explode("dissent").alias("source", "value"))


@query("x02_unified_records", CELLS + """ SELECT r.date::VARCHAR AS date, r.home_key, r.away_key, r.n_sources, r.sources,
  coalesce(string_agg(c.field, '|' ORDER BY c.field) FILTER (NOT c.agreed), '') AS conflicts, count(c.field) AS n_fields
  FROM (SELECT date, home_key, away_key, count(*) AS n_sources, string_agg(source, '|' ORDER BY source) AS sources FROM resolved GROUP BY ALL) r
  LEFT JOIN cells c USING (date, home_key, away_key) GROUP BY ALL""", PR)
def x02(spark, d):
    resolved = _resolved(spark, d)
    return U.unified(U.fuse(resolved, PRIORS), resolved)


@query("a18_agreement_report", CELLS + """ SELECT field, count(*) FILTER (n_claims >= 2) AS compared,
  count(*) FILTER (n_claims >= 2 AND agreed) AS agreed, R(count(*) FILTER (n_claims >= 2 AND agreed) / count(*) FILTER (n_claims >= 2)) AS rate
  FROM cells GROUP BY field""", PR)
def a18(spark, d):
    return U.agreement(_cells(spark, d))


MEASURED = """measured AS (SELECT f.source, count(*) FILTER (list_contains(c.sources, f.source)) AS hits, count(*) AS total,
  round(count(*) FILTER (list_contains(c.sources, f.source)) / count(*), 3) AS rate
  FROM facts f JOIN cells c USING (date, home_key, away_key, field) WHERE c.n_claims >= 2 GROUP BY 1)"""


@query("a19_measured_reliability", CELLS + "," + MEASURED + " SELECT source, hits, total, R(rate) AS rate FROM measured", PR)
def a19(spark, d):
    return U.measured_reliability(_cells(spark, d))


SKEWED = {"alpha": 0.90, "beta": 0.50, "gamma": 0.95}


@query("x03_refuse_flips", RESOLVED + "," + cells_sql("0.90", "0.50", "0.95") + "," + MEASURED + "," + cells_sql(
    "(SELECT rate FROM measured WHERE source = 'alpha')", "(SELECT rate FROM measured WHERE source = 'beta')",
    "(SELECT rate FROM measured WHERE source = 'gamma')", "2") + """
  SELECT a.date::VARCHAR AS date, a.home_key, a.away_key, a.field, R(a.value) AS before, R(b.value) AS after
  FROM cells a JOIN cells2 b USING (date, home_key, away_key, field) WHERE a.value <> b.value""", PR)
def x03(spark, d):
    rows = cut(_resolved(spark, d))
    return U.refuse_flips(rows, SKEWED, U.measured_reliability(U.fuse(rows, SKEWED)))


@query("x01_tolerance_clusters", RESOLVED + """,
wide AS (SELECT date, home_key, away_key, field, max(value) FILTER (source = 'alpha') AS a, max(value) FILTER (source = 'beta') AS b,
  max(value) FILTER (source = 'gamma') AS g FROM facts GROUP BY ALL)
SELECT date::VARCHAR AS date, home_key, away_key, field, CASE
    WHEN a IS NULL AND b IS NULL THEN R(g) WHEN a IS NULL AND g IS NULL THEN R(b) WHEN b IS NULL AND g IS NULL THEN R(a)
    WHEN g IS NULL THEN CASE WHEN abs(a - b) <= 1 THEN R((a + b) / 2) ELSE R(a) END
    WHEN b IS NULL THEN CASE WHEN abs(a - g) <= 1 THEN R((a + g) / 2) ELSE R(a) END
    WHEN a IS NULL THEN CASE WHEN abs(b - g) <= 1 THEN R((b + g) / 2) ELSE R(b) END
    WHEN abs(a - b) <= 1 AND abs(a - g) <= 1 THEN R((a + b + g) / 3)
    WHEN abs(a - b) <= 1 THEN R((a + b) / 2) WHEN abs(a - g) <= 1 THEN R((a + g) / 2)
    WHEN abs(b - g) <= 1 THEN R((b + g) / 2) ELSE R(a) END AS value FROM wide""", PR)
def x01_tol(spark, d):
    within_one = {f: 1.0 for f in FUSED_FIELDS}
    return U.fuse(_resolved(spark, d), PRIORS, within_one).where("n_claims > 0").select(*U.FIXTURE, "field", "value")


@query("s18_fused_upsert", CELLS + """,
old AS (SELECT date, home_key, away_key, field, value FROM cells WHERE year(date) < 1999),
new AS (SELECT date, home_key, away_key, field, value + 1 AS value FROM cells WHERE year(date) >= 1998)
SELECT date::VARCHAR AS date, home_key, away_key, field, R(coalesce(n.value, o.value)) AS value,
  CASE WHEN n.date IS NULL THEN 'kept' WHEN o.date IS NULL THEN 'stored' ELSE 'updated' END AS action
FROM (SELECT *, true AS o FROM old) o FULL JOIN new n USING (date, home_key, away_key, field)""".replace("WHEN o.date IS NULL", "WHEN o.o IS NULL"), PR)
def s18(spark, d):
    cells = _cells(spark, d).where("n_claims > 0").select(*U.FIXTURE, "field", "value")
    old = cells.where(F.year("date") < 1999)
    new = cells.where(F.year("date") >= 1998).withColumn("value", F.col("value") + 1)
    return U.upsert(old, new, [*U.FIXTURE, "field"])


@query("x04_lift_fused", CELLS + """ SELECT field AS kind, 'observed' AS layer,
  'match_' || substr(sha256(date || '|' || home_key || '|' || away_key), 1, 16) AS match_id, date::VARCHAR AS date,
  home_key AS home, away_key AS away, 'fusion' AS source, 'fuse:' || field AS transformation, R(confidence) AS confidence FROM cells""", PR)
def x04(spark, d):
    return U.lift_cells(_cells(spark, d)).drop("value", "id")


@query("x05_canonical_matches", RESOLVED + """ SELECT source, date::VARCHAR AS date, home_key, away_key, seq,
  'match_' || substr(sha256(date || '|' || home_key || '|' || away_key), 1, 16) AS match_id,
  'team_' || substr(sha256(home_key), 1, 16) AS home_team_id, 'team_' || substr(sha256(away_key), 1, 16) AS away_team_id,
  'stage:canonical' AS stage FROM resolved""", PR)
def x05(spark, d):
    return U.canonical_match(provider_records(spark, d), _aliases(spark)).select(
        "source", *U.FIXTURE, "seq", "match_id", "home_team_id", "away_team_id", "stage")


@query("x06_fuse_preconditions", """ SELECT kind, player_id, CASE WHEN n < 2 THEN 'fewer than two records' WHEN l0 <> l1 THEN 'several layers'
    WHEN n_fact > 0 AND n_fact < n THEN 'facts mixed with inference' WHEN t0 <> t1 THEN 'different targets'
    WHEN s0 IS NOT DISTINCT FROM s1 THEN 'single source' END AS problem
  FROM (SELECT kind, player_id, count(*) AS n, min(layer) AS l0, max(layer) AS l1,
      count(*) FILTER (layer IN ('observed','historical','youth','external')) AS n_fact,
      min(coalesce(team, '~')) AS t0, max(coalesce(team, '~')) AS t1, min(source) AS s0, max(source) AS s1 FROM knowledge GROUP BY ALL)
  WHERE problem IS NOT NULL""", ("knowledge",))
def x06(spark, d):
    from pitchgrid.bindings.tables import knowledge
    return U.fuse_preconditions(knowledge(spark, d), ["kind", "player_id"], [F.col("team")])


@query("a20_weighted_consensus", """ SELECT date::VARCHAR AS date, league, CASE WHEN total <> 0 THEN claim END AS claim, R(w / total) AS agreement FROM (
  SELECT date, league, claim, w, sum(w) OVER (PARTITION BY date, league) AS total,
    row_number() OVER (PARTITION BY date, league ORDER BY w DESC, claim) AS rk
  FROM (SELECT date, league, CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END AS claim,
      sum(1 + cents % 3) AS w FROM fixtures GROUP BY ALL)) WHERE rk = 1""", ("fixtures",))
def a20(spark, d):
    h, a = F.col("home_goals"), F.col("away_goals")
    r = fixtures(spark, d).select("date", "league", F.when(h > a, "home").when(h == a, "draw").otherwise("away").alias("claim"),
                                  (1 + F.pmod("cents", F.lit(3))).alias("weight"))
    return U.consensus(r, ["date", "league"])


def _streams(spark, d):
    ev = match_events(spark, d)
    drop = F.pmod("event_id", F.lit(9))
    base = ev.select("match_id", "event_id", "minute", "team", "type")
    return (
        base.withColumn("source", F.lit("alpha"))
        .unionByName(base.where(drop != 4).withColumn("minute", F.col("minute") + 0.75).withColumn("source", F.lit("beta")))
        .unionByName(base.where(drop != 7).withColumn("minute", F.col("minute") - 0.5).withColumn("source", F.lit("gamma"))))


STREAMS = """
streams AS (SELECT 'alpha' AS source, match_id, event_id, minute, type FROM match_events
  UNION ALL SELECT 'beta', match_id, event_id, minute + 0.75, type FROM match_events WHERE event_id % 9 <> 4
  UNION ALL SELECT 'gamma', match_id, event_id, minute - 0.5, type FROM match_events WHERE event_id % 9 <> 7),
anchors AS (SELECT match_id, source, list(minute ORDER BY minute) AS a FROM streams WHERE type = 'goal' GROUP BY ALL),
walk AS (SELECT s.match_id, s.source, r.a AS left_, o.a AS b, 0 AS i, []::DOUBLE[] AS diffs, NULL::STRUCT(d DOUBLE, x DOUBLE) AS pick FROM (SELECT DISTINCT match_id, source FROM streams WHERE source <> 'alpha') s
    JOIN anchors r ON r.match_id = s.match_id AND r.source = 'alpha' JOIN anchors o ON o.match_id = s.match_id AND o.source = s.source
  UNION ALL SELECT match_id, source, CASE WHEN near.d <= 5 THEN list_filter(left_, lambda v: v <> near.x) ELSE left_ END, b, i + 1, CASE WHEN near.d <= 5 THEN list_append(diffs, b[i + 1] - near.x) ELSE diffs END, near
  FROM (SELECT *, list_sort(list_transform(left_, lambda v: {'d': abs(b[i + 1] - v), 'x': v}))[1] AS near FROM walk WHERE i < len(b))),
offsets AS (SELECT s.match_id, s.source, coalesce((SELECT CASE WHEN len(diffs) = 0 THEN 0 ELSE round(list_median(diffs), 3) END FROM walk w WHERE w.match_id = s.match_id AND w.source = s.source AND i = len(b)), 0) AS "offset"
  FROM (SELECT DISTINCT match_id, source FROM streams) s)"""


@query("j11_clock_offsets", STREAMS + ' SELECT match_id, source, R("offset") AS "offset" FROM offsets', ("match_events",))
def j11(spark, d):
    return U.clock_offsets(_streams(spark, d))


@query("u01_aligned_timeline", STREAMS + ' SELECT match_id, event_id, source, type, R(round(minute - "offset", 3)) AS aligned_minute FROM streams JOIN offsets USING (match_id, source)', ("match_events",))
def u01(spark, d):
    s = _streams(spark, d)
    return U.align(s, U.clock_offsets(s)).select("match_id", "event_id", "source", "type", "aligned_minute")


@query("j18_crosscheck", CELLS + """,
fx AS (SELECT date, CASE hk WHEN 'atletico l0 t0' THEN 'athletic l0 t0' ELSE hk END AS home_key0, hk AS home_key, ak AS away_key, seq, home_goals, away_goals
  FROM (SELECT *, 'atletico ' || lower(league) || ' ' || lower(home) AS hk, 'atletico ' || lower(league) || ' ' || lower(away) AS ak FROM fixtures)),
goals AS (SELECT date, home_key, away_key, max(value) FILTER (field = 'home_goals') AS fh, max(value) FILTER (field = 'away_goals') AS fa
  FROM cells WHERE field IN ('home_goals', 'away_goals') GROUP BY ALL)
SELECT f.seq, CASE WHEN fh IS NULL THEN 'unmatched' WHEN fh = home_goals AND fa = away_goals THEN 'confirmed' ELSE 'differs' END AS status
FROM fx f LEFT JOIN goals g ON g.date = f.date AND g.home_key = f.home_key AND g.away_key = f.away_key""", PR)
def j18(spark, d):
    fx = fixtures(spark, d)
    name = lambda c: F.concat_ws(" ", F.lit("Atlético"), "league", c)
    m = fx.select("seq", "date", name("home").alias("home"), name("away").alias("away"), "home_goals", "away_goals")
    return U.crosscheck(m, _cells(spark, d)).select("seq", "status")


@query("j18_crosscheck_report", CELLS + """,
fx AS (SELECT date, 'atletico ' || lower(league) || ' ' || lower(home) AS home_key, 'atletico ' || lower(league) || ' ' || lower(away) AS away_key, seq FROM fixtures),
cf AS (SELECT date, home_key, away_key, count(*) FILTER (n_claims >= 2) AS compared, count(*) FILTER (n_claims > 0 AND agreed) AS agreed,
  coalesce(string_agg(field, '|' ORDER BY field) FILTER (n_claims > 0 AND NOT agreed), '') AS conflicts FROM cells GROUP BY ALL),
rs AS (SELECT date, home_key, away_key, count(DISTINCT source) AS providers, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, min(league) AS league FROM resolved GROUP BY ALL)
SELECT seq, (rs.date IS NOT NULL AND cf.date IS NOT NULL)::BIGINT AS verified, coalesce(providers, 1) AS providers, sources, compared AS fields_compared, agreed AS fields_agreed, conflicts, rs.league AS league
FROM fx LEFT JOIN rs ON rs.date = fx.date AND rs.home_key = fx.home_key AND rs.away_key = fx.away_key LEFT JOIN cf ON cf.date = fx.date AND cf.home_key = fx.home_key AND cf.away_key = fx.away_key""", PR)
def j18_report(spark, d):
    name = lambda c: F.concat_ws(" ", F.lit("Atlético"), "league", c)
    m = fixtures(spark, d).select("seq", "date", name("home").alias("home"), name("away").alias("away"))
    return U.crosscheck_report(m, _cells(spark, d), _resolved(spark, d))


@query("p05_fused_list", CELLS + """, u AS (SELECT date, home_key, away_key, string_agg(field, '|' ORDER BY field) FILTER (NOT agreed) AS conflicts FROM cells GROUP BY ALL)
  SELECT date::VARCHAR AS date, home_key, away_key, conflicts FROM u WHERE conflicts IS NOT NULL AND contains(home_key, 'l1 ') ORDER BY u.date DESC, home_key, away_key LIMIT 100""", PR)
def p05(spark, d):
    rows = _resolved(spark, d)
    listed = U.unified(U.fuse(rows, PRIORS), rows).where(F.contains("home_key", F.lit("l1 ")) & (F.size("conflicts") > 0))
    return listed.orderBy(F.col("date").desc(), "home_key", "away_key").limit(100).select(*U.FIXTURE, "conflicts")
