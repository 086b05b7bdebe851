"""Queries: scoring, fitting, walk-forward and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings import state_sql as Q
from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import load, match_events, matches
from pitchgrid.operators.ordered import numbered
from pitchgrid.plans import calibration as C
from pitchgrid.plans import snapshots as S
from pitchgrid.settings import BASE_RATE_GRID, REGIME_SCALE_GRID, TAU_GRID, Params

EV = ("match_events",)
EM = ("match_events", "matches")
FOLDS = 4
LL = "-(y * ln(least(1 - 1e-15, greatest(1e-15, {p}))) + (1 - y) * ln(1 - least(1 - 1e-15, greatest(1e-15, {p}))))"
MEANS = """R(avg((prob - y) ** 2)) AS brier, R(avg(""" + LL.format(p="prob") + """)) AS log_loss,
  R(avg(prob)) AS mean_pred, R(avg(y)) AS base_freq, R(abs(avg(prob) - avg(y))) AS gap"""
SNAP = Q.SNAPSHOTS + ", scored AS (SELECT *, happened AS y FROM snaps)"


def _snaps(spark, d):
    return S.snapshots(match_events(spark, d))


@query("a15_m02_backtest_scores", SNAP + f" SELECT count(*) AS n, {MEANS} FROM scored", EV)
def a15(spark, d):
    return C.evaluate(_snaps(spark, d))


@query("a15_scores_by_regime", SNAP + f" SELECT regime, count(*) AS n, {MEANS} FROM scored GROUP BY regime", EV)
def a15_regime(spark, d):
    return C.evaluate(_snaps(spark, d), ["regime"])


@query("m02_backtest_pairs", SNAP + """ SELECT match_id, t AS minute, 'goal_10min' AS target, R(prob) AS prob,
  happened::BIGINT AS happened FROM scored""", EV)
def m02(spark, d):
    return _snaps(spark, d).select("match_id", "minute", F.lit("goal_10min").alias("target"), "prob", "happened")


@query("a16_reliability_bands", SNAP + """ SELECT least(9, floor(prob * 10))::BIGINT AS band, R(avg(prob)) AS predicted,
  R(avg(y)) AS observed, count(*) AS n FROM scored GROUP BY 1""", EV)
def a16(spark, d):
    return C.reliability(_snaps(spark, d))


@query("a16_max_deviation", SNAP + """ SELECT R(max(abs(p - o))) AS max_deviation FROM (
  SELECT avg(prob) AS p, avg(y) AS o FROM scored GROUP BY least(9, floor(prob * 10)))""", EV)
def a16_dev(spark, d):
    return C.max_reliability_deviation(_snaps(spark, d))


@query("a26_regime_frequencies", SNAP + " SELECT regime, count(*) AS n, R(count(*) / sum(count(*)) OVER ()) AS share FROM scored GROUP BY regime", EV)
def a26(spark, d):
    counts = _snaps(spark, d).groupBy("regime").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("regime", "n", (F.col("n") / F.col("total")).alias("share"))


@query("a25_target_rate", Q.SNAPSHOT_GRID + "," + Q.state() + """ SELECT R(n / minutes) AS rate, n AS n_events, R(mean_pressure) AS mean_pressure
  FROM (SELECT count(*) FILTER (type = 'corner') AS n FROM match_events),
       (SELECT sum(m) AS minutes FROM (SELECT floor(max(minute)) + 1 AS m FROM match_events GROUP BY match_id)),
       (SELECT avg(press_home + press_away) AS mean_pressure FROM read)""", EV)
def a25(spark, d):
    return C.rate_and_pressure(match_events(spark, d), ("corner",))


# candidate table: 0 the start, -1 the active parameters, 1.. the grid base-major
_CANDS = ", ".join(
    [f"(0, 0.015::DOUBLE, 8.0::DOUBLE)", "(-1, 0.012::DOUBLE, 12.0::DOUBLE)"]
    + [f"({1 + j * len(TAU_GRID) + i}, {b}::DOUBLE, {t}::DOUBLE)" for j, b in enumerate(BASE_RATE_GRID) for i, t in enumerate(TAU_GRID)])
CAND = (
    Q.SNAPSHOT_GRID.replace("grid AS (", "grid0 AS (") + f""",
grid AS (SELECT g.*, tau FROM grid0 g, (VALUES {", ".join(f"({t}::DOUBLE)" for t in TAU_GRID)}) v(tau)),"""
    + Q.state(tau="g.tau", extra="tau") + f""",
cand AS (SELECT * FROM (VALUES {_CANDS}) c(candidate, base_rate, tau)),
cscore AS (
  SELECT r.match_id, c.candidate, c.base_rate, c.tau, {Q.outcome()} AS y,
    1 - exp(-(c.base_rate * (unit_home + unit_away)) * 10) AS p
  FROM read r JOIN cand c ON c.tau = r.tau),
ordered AS (
  SELECT match_id, competition, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS total FROM matches)""")


def _scores(spark, d, groups, cols, also=()):
    return C.candidate_scores(match_events(spark, d), groups, cols, also=also)


@query("m03_fit_parameters", CAND + f""" SELECT competition, base_rate, tau, n, R(ll) AS log_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY competition ORDER BY ll, candidate) AS rk FROM (
    SELECT competition, candidate, base_rate, tau, count(*) AS n, avg({LL.format(p='p')}) AS ll
    FROM cscore JOIN ordered USING (match_id) WHERE candidate >= 0 GROUP BY ALL)) WHERE rk = 1""", EM)
def m03(spark, d):
    groups = matches(spark, d).select("match_id", "competition")
    return C.best(_scores(spark, d, groups, ["competition"]), ["competition"]).select(
        "competition", "base_rate", "tau", "n", (F.col("ll_sum") / F.col("n")).alias("log_loss"))


@query("m03_j13_candidate_costs", CAND + f""" SELECT candidate::BIGINT AS candidate, base_rate, tau, count(*) AS n, R(avg({LL.format(p='p')})) AS log_loss,
  R(avg((p - y) ** 2)) AS brier FROM cscore GROUP BY ALL""", EV)
def m03_costs(spark, d):
    events = match_events(spark, d)
    groups = events.select("match_id").distinct().withColumn("all", F.lit("all"))
    scores = _scores(spark, d, groups, ["all"], also=(Params(0.012, 12.0),))
    return scores.select("candidate", "base_rate", "tau", "n", (F.col("ll_sum") / F.col("n")).alias("log_loss"),
                         (F.col("brier_sum") / F.col("n")).alias("brier"))


BLOCKS = f"""blocks AS (SELECT match_id, block FROM (
  SELECT match_id, ((rn - 1) // (total // {FOLDS + 1}))::BIGINT AS block FROM ordered) WHERE block <= {FOLDS})"""


@query("w23_walk_forward_folds", f"""ordered AS (
  SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS total FROM matches), {BLOCKS}
  SELECT match_id, block FROM blocks""", ("matches",))
def w23(spark, d):
    return C.folds(matches(spark, d), FOLDS, ["match_date", "match_id"])


@query("m05_walk_forward_report", CAND + f""", {BLOCKS},
per AS (SELECT f.fold, c.candidate, c.base_rate, c.tau, avg({LL.format(p='p')}) FILTER (b.block < f.fold) AS train_ll,
    count(*) FILTER (b.block < f.fold) AS train_n, count(*) FILTER (b.block = f.fold) AS n,
    avg((p - y) ** 2) FILTER (b.block = f.fold) AS brier, avg({LL.format(p='p')}) FILTER (b.block = f.fold) AS log_loss,
    avg(p) FILTER (b.block = f.fold) AS mean_pred, avg(y) FILTER (b.block = f.fold) AS base_freq
  FROM cscore c JOIN blocks b USING (match_id), (SELECT unnest(range(1, {FOLDS + 1})) AS fold) f WHERE candidate >= 0
  GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_ll, candidate) AS rk FROM per)
SELECT a.fold AS block, a.base_rate AS fitted_base_rate, a.tau AS fitted_tau, a.train_n, a.n, R(a.brier) AS brier,
  R(a.log_loss) AS log_loss, R(a.mean_pred) AS mean_pred, R(a.base_freq) AS base_freq, R(abs(a.mean_pred - a.base_freq)) AS gap,
  R(b.brier) AS baseline_brier, R(b.log_loss) AS baseline_log_loss
FROM chosen a JOIN per b ON b.fold = a.fold AND b.candidate = 0 WHERE a.rk = 1""", EM)
def m05(spark, d):
    blocks = C.folds(matches(spark, d), FOLDS, ["match_date", "match_id"])
    return C.walk_forward(_scores(spark, d, blocks, ["block"]), FOLDS)


@query("m07_promotion_gate", CAND + f""",
parts AS (SELECT match_id, rn <= greatest(1, floor(total * 0.75)) AS train FROM ordered),
per AS (SELECT candidate, base_rate, tau, avg({LL.format(p='p')}) FILTER (train) AS train_ll, avg({LL.format(p='p')}) FILTER (NOT train) AS hold_ll
  FROM cscore JOIN parts USING (match_id) GROUP BY ALL)
SELECT a.base_rate, a.tau, R(a.hold_ll) AS holdout_log_loss, R(b.hold_ll) AS baseline_log_loss,
  (a.hold_ll <= b.hold_ll)::BIGINT AS promoted
FROM (SELECT * FROM per WHERE candidate >= 0 ORDER BY train_ll, candidate LIMIT 1) a, per b WHERE b.candidate = -1""", EM)
def m07(spark, d):
    parts = C.holdout_parts(matches(spark, d), ["match_date", "match_id"])
    return C.recalibrate(_scores(spark, d, parts, ["part"], also=(Params(0.012, 12.0),)))


@query("m16_j16_competition_cross_fit", CAND + f""",
per AS (SELECT competition, candidate, base_rate, tau, count(*) AS n, avg({LL.format(p='p')}) AS ll
  FROM cscore JOIN ordered USING (match_id) WHERE candidate >= 0 GROUP BY ALL),
fit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY ll, candidate) AS rk FROM per) WHERE rk = 1)
SELECT f.competition AS fitted_on, f.base_rate, f.tau, p.competition AS scored_on, p.n, R(p.ll) AS log_loss
FROM fit f JOIN per p ON p.candidate = f.candidate""", EM)
def m16(spark, d):
    groups = matches(spark, d).select("match_id", "competition")
    return C.cross_fit(_scores(spark, d, groups, ["competition"]))


_SCALES = ", ".join(f"({i}, {s}::DOUBLE)" for i, s in enumerate((1.0, *REGIME_SCALE_GRID)))


@query("m04_regime_scale", SNAP + f""",
per AS (SELECT regime, k, s, count(*) AS n, avg({LL.format(p='(1 - exp(-(lam_home + lam_away) * s * 10))')}) AS ll
  FROM scored, (VALUES {_SCALES}) v(k, s) GROUP BY ALL)
SELECT regime, s AS scale, n FROM (
  SELECT *, row_number() OVER (PARTITION BY regime ORDER BY ll, k) AS rk FROM per WHERE k = 0 OR n >= 40) WHERE rk = 1""", EV)
def m04(spark, d):
    return C.fit_regime_scale(match_events(spark, d), Params())


@query("m08_p11_active_params", """v AS (
  SELECT o_orderkey AS id, 'C' || (o_custkey % 7) AS competition, (5 + o_orderkey % 20)::DOUBLE / 1000.0::DOUBLE AS base_rate,
    (4 + o_orderkey % 9)::DOUBLE AS tau, o_orderstatus = 'F' AND o_custkey % 7 < 5 AS promoted FROM orders),
own AS (SELECT competition, max(id) AS id FROM v WHERE promoted GROUP BY 1)
SELECT c.competition, x.id AS version, R(x.base_rate) AS base_rate, x.tau AS tau
FROM (SELECT DISTINCT competition FROM v) c LEFT JOIN own USING (competition)
JOIN v x ON x.id = coalesce(own.id, (SELECT max(id) FROM v WHERE promoted))""", ("fixtures",))
def m08(spark, d):
    v = _versions(spark, d)
    return C.active_params(v, v.select("competition").distinct())


def _versions(spark, d):
    o = load(spark, d, "orders")
    comp = F.pmod("o_custkey", F.lit(7))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), comp.cast("string")).alias("competition"),
                    ((5 + F.pmod("o_orderkey", F.lit(20))) / 1000.0).alias("base_rate"),
                    (4 + F.pmod("o_orderkey", F.lit(9))).cast("double").alias("tau"),
                    ((F.col("o_orderstatus") == "F") & (comp < 5)).alias("promoted"))


@query("p11_learning_runs", """v AS (
  SELECT o_orderkey AS id, 'C' || (o_custkey % 7) AS competition, (5 + o_orderkey % 20)::DOUBLE / 1000.0::DOUBLE AS base_rate,
    (4 + o_orderkey % 9)::DOUBLE AS tau, o_orderstatus = 'F' AND o_custkey % 7 < 5 AS promoted FROM orders),
own AS (SELECT competition, max(id) AS id FROM v WHERE promoted GROUP BY 1),
act AS (SELECT coalesce(own.id, (SELECT max(id) FROM v WHERE promoted)) AS id, count(*) AS serves FROM (SELECT DISTINCT competition FROM v) c LEFT JOIN own USING (competition) GROUP BY 1)
SELECT row_number() OVER (ORDER BY id DESC) AS place, id, competition, R(base_rate) AS base_rate, tau, promoted::BIGINT AS promoted, coalesce(serves, 0)::BIGINT AS serves FROM v LEFT JOIN act USING (id)""", ("fixtures",))
def p11(spark, d):
    """The list as it is ordered: ``place`` numbers its rows, a part of the order after the other."""
    v = _versions(spark, d)
    runs = C.learning_runs(v, v.select("competition").distinct())
    return numbered(runs, [], -F.floor(F.col("id") / 1000), [F.col("id").desc()], "place")


TARGETS = {"corner": ("corner",), "card": ("yellow_card", "red_card")}
_TSQL = "CASE tg WHEN 'corner' THEN e.type = 'corner' ELSE e.type IN ('yellow_card', 'red_card') END"


@query("m09_other_targets", Q.SNAPSHOT_GRID + "," + Q.state() + f""",
ordered AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS total FROM matches),
{BLOCKS},
tg AS (SELECT unnest(['corner', 'card']) AS tg),
ev AS (SELECT tg, f.fold, count(*) AS n FROM match_events e JOIN blocks b USING (match_id), tg,
    (SELECT unnest(range(1, {FOLDS + 1})) AS fold) f WHERE b.block < f.fold AND ({_TSQL}) GROUP BY ALL),
mins AS (SELECT f.fold, sum(m) AS minutes FROM (SELECT match_id, floor(max(minute)) + 1 AS m FROM match_events GROUP BY 1) x
    JOIN blocks b USING (match_id), (SELECT unnest(range(1, {FOLDS + 1})) AS fold) f WHERE b.block < f.fold GROUP BY 1),
press AS (SELECT f.fold, avg(press_home + press_away) AS mp FROM read r JOIN blocks b USING (match_id),
    (SELECT unnest(range(1, {FOLDS + 1})) AS fold) f WHERE b.block < f.fold GROUP BY 1),
test AS (SELECT tg, ev.n / mins.minutes AS rate, least(4.0, greatest(0.25, (press_home + press_away) / mp)) AS scale,
    (SELECT count(*) > 0 FROM match_events e WHERE e.match_id = r.match_id AND ({_TSQL}) AND e.minute > r.t AND e.minute <= r.t + 10)::INTEGER AS y
  FROM read r JOIN blocks b USING (match_id) JOIN mins ON mins.fold = b.block JOIN press ON press.fold = b.block JOIN ev ON ev.fold = b.block),
long AS (SELECT tg, 'constant' AS model, y, 1 - exp(-rate * 10) AS prob FROM test
  UNION ALL SELECT tg, 'scaled', y, 1 - exp(-rate * scale * 10) FROM test)
SELECT tg AS target, model, count(*) AS n, {MEANS} FROM long GROUP BY ALL""", EM)
def m09(spark, d):
    blocks = C.folds(matches(spark, d), FOLDS, ["match_date", "match_id"])
    return C.target_benchmark(match_events(spark, d), blocks, TARGETS)


@query("f15_m06_snapshot_features", SNAP + """ SELECT match_id, t AS minute, R(press_home + press_away) AS pressure,
  R(greatest(momentum, 1 - momentum)) AS dominance, R(t / 90.0) AS clock, CASE WHEN t >= 75 THEN 1.0 ELSE 0.0 END::DOUBLE AS late,
  abs(home_goals - away_goals)::DOUBLE AS margin, recent_shots::DOUBLE AS recent_shots, happened::BIGINT AS happened FROM scored""", EV)
def f15(spark, d):
    return C.snapshot_features(match_events(spark, d))


@query("m06_logistic_model")
def m06(spark, d):
    features = C.snapshot_features(match_events(spark, d)).join(
        C.holdout_parts(matches(spark, d), ["match_date", "match_id"]), "match_id")
    model = C.train_logistic(features.where("part = 'train'"))
    return C.evaluate(C.score_logistic(model, features), ["part"])


@query("m06_training_checks", SNAP + """, ordered AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS total FROM matches)
SELECT count(*) AS n, sum(happened)::BIGINT AS n_happened, 1::BIGINT AS stationary, 1::BIGINT AS beats_constant
FROM scored JOIN ordered USING (match_id) WHERE rn <= greatest(1, floor(total * 0.75))""", EM)
def m06_checks(spark, d):
    features = C.snapshot_features(match_events(spark, d)).join(
        C.holdout_parts(matches(spark, d), ["match_date", "match_id"]), "match_id").where("part = 'train'")
    return C.training_checks(C.train_logistic(features), features)
