import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions.scoring import prob_at_least
from pitchgrid.plans import matches as M
from pitchgrid.plans import narrative as N
from pitchgrid.plans import players as P
from pitchgrid.plans import projection as J
from pitchgrid.plans import ratings as R
from pitchgrid.plans import tracking as V


def _state(spark, rows):
    return spark.createDataFrame(rows, "match_id string, t int, duration int, home_goals long, away_goals long, lam_home double, lam_away double")


def test_projection_equals_simulation_of_the_same_process(spark):
    s = J.with_slices(_state(spark, [("m", 60, 90, 1, 0, 0.02, 0.03)]))
    exact = J.project(s).first()
    assert exact.slices == 120 and exact.home_win + exact.draw + exact.away_win == pytest.approx(1.0)
    rnd = np.random.default_rng(3)
    home, away = 1 + rnd.binomial(120, 0.005, 200_000), rnd.binomial(120, 0.0075, 200_000)
    assert exact.home_win == pytest.approx((home > away).mean(), abs=0.005) and exact.draw == pytest.approx((home == away).mean(), abs=0.005)


def test_projection_has_no_largest_goal_count(spark):
    rows = [("even", 0, 95, 0, 0, 0.8, 0.8), ("reds", 0, 95, 0, 0, 0.381, 0.0), ("long", 0, 1000, 0, 0, 3.99, 3.99), ("behind", 0, 95, 0, 60, 0.8, 0.0)]
    got = {r.match_id: r for r in J.project(J.with_slices(_state(spark, rows))).collect()}
    assert got["even"].home_win == pytest.approx(got["even"].away_win) and got["even"].home_win > 0.4
    assert got["reds"].away_win == 0 and got["reds"].home_win == pytest.approx(1.0, abs=1e-9)
    assert all(r.home_win + r.draw + r.away_win == pytest.approx(1.0) for r in got.values())
    assert 0.9 < got["behind"].home_win < 1 and J.scorelines(J.with_slices(_state(spark, rows[:1])), 9).count() == 9


def test_projection_without_time_left_reads_the_score(spark):
    rows = [("a", 90, 90, 2, 1, 0.02, 0.02), ("b", 90, 90, 1, 1, 0.02, 0.02), ("c", 95, 90, 0, 3, 0.02, 0.02)]
    got = {r.match_id: (r.home_win, r.draw, r.away_win) for r in J.project(J.with_slices(_state(spark, rows))).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 1, 0), "c": (0, 0, 1)}


def test_decisions_compare_with_keeping_the_shape(spark):
    rows = J.rank_decisions(_state(spark, [("m", 80, 90, 1, 0, 0.01, 0.05)]), "HOME").collect()
    by = {r.approach: r for r in rows}
    assert by["keep"].delta_win == 0 and by["defend"].delta_win > 0.005 and {r.recommended for r in rows} == {"defend"}


def test_poisson_tail(spark):
    r = spark.range(1).select(*[prob_at_least(F.lit(2.0), k).alias(f"p{k}") for k in (0, 1, 3)]).first()
    assert r.p0 == 1 and r.p1 == pytest.approx(1 - math.exp(-2)) and r.p3 == pytest.approx(1 - math.exp(-2) * 5)


FIX = "league string, season string, seq long, date date, home string, away string, home_goals int, away_goals int, odds_h double, odds_d double, odds_a double"


def _fixtures(spark, n=40, seed=5):
    import datetime as dt
    rnd, rows = random.Random(seed), []
    for i in range(n):
        h, a = rnd.sample("ABCDE", 2)
        rows.append(("L", "S", i, dt.date(2024, 1, 1) + dt.timedelta(i // 3), h, a, rnd.randint(0, 3), rnd.randint(0, 2), 2.0, 3.0, 4.0))
    return rows, spark.createDataFrame(rows, FIX)


def test_elo_is_the_same_for_any_batches_and_split(spark):
    rows, df = _fixtures(spark)
    other = df.withColumn("league", F.lit(None).cast("string")).withColumn("seq", F.col("seq") + 1000)
    rating, want = {}, {}
    for _, _, seq, _, h, a, hg, ag, *_ in rows:
        e = 1 / (1 + 10 ** (-(rating.get(h, 1500) + 60 - rating.get(a, 1500)) / 400))
        want[seq] = e
        delta = 20 * ((1 if hg > ag else 0.5 if hg == ag else 0) - e)
        rating[h], rating[a] = rating.get(h, 1500) + delta, rating.get(a, 1500) - delta
    want |= {seq + 1000: e for seq, e in want.items()}  # a league without a name goes its own way
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    for size in ("1000", "7"):
        spark.conf.set(name, size)
        got = {r.seq: r.expected_home for r in R.elo(df.unionByName(other).repartition(5)).collect()}
        assert got == pytest.approx(want)
    spark.conf.set(name, was)
    assert R.elo(df.limit(0)).collect() == []


def test_attack_defence_reads_only_earlier_matches(spark):
    rows, df = _fixtures(spark)
    full = {r.seq: (r.lam_home, r.lam_away) for r in R.attack_defence(df).collect()}
    early = {r.seq: (r.lam_home, r.lam_away) for r in R.attack_defence(df.where("seq < 20")).collect()}
    assert full[0] == pytest.approx((1.45, 1.15))
    assert all(full[s] == pytest.approx(early[s]) for s in early)
    p = R.attack_defence(df).first()
    assert p.poisson_h + p.poisson_d + p.poisson_a == pytest.approx(1)


def test_leads_and_presets(events):
    rows = [("m", 10, "HOME", "goal"), ("m", 20, "HOME", "goal"), ("m", 50, "AWAY", "goal"), ("m", 60, "AWAY", "goal"), ("m", 88, "AWAY", "goal")]
    facts = M.match_facts(events(rows))
    f = facts.first()
    assert (f.max_home_lead, f.max_away_lead, f.lead_changes, f.goals_from_85) == (2, 1, 2, 1)
    got = {r.preset: r.stat for r in M.presets(facts).collect()}
    assert got == {"comebacks": "AWAY", "blown_leads": "HOME +2", "goal_fests": "5", "late_drama": "1"}


def test_what_if_removes_exactly_one_event(spark, events):
    df = events([("m", 30.2, "HOME", "goal"), ("m", 30.4, "HOME", "goal"), ("m", 90, "AWAY", "shot")])
    req = spark.createDataFrame([("m", "goal", "HOME", 30.5)], "match_id string, type string, team string, at double")
    assert M.find_events(df, req).first().event_id == 1
    last = M.what_if_summary(M.what_if(df, req)).first()
    assert (last.base_home_goals, last.cf_home_goals) == (2, 1)
    far = req.withColumn("at", F.lit(32.0))
    assert M.find_events(df, far).count() == 0


def test_metric_errors_become_rows(events):
    reg = M.MetricRegistry()
    reg.register("chaos")(M.expected_chaos)
    reg.register_python("broken", init=int, step=lambda n, rows: 1 / 0, merge=lambda a, b: a + b, finish=lambda n: (n, ""))
    reg.register_python("events", init=int, step=lambda n, rows: n + len(rows), merge=lambda a, b: a + b, finish=lambda n: (n, "events"))
    reg.register("unplannable")(lambda e, p: e.select("nowhere"))
    got = {r.metric: r for r in reg.run(events([("m", 10, "HOME", "goal"), ("m", 40, "AWAY", "shot")])).collect()}
    assert got["broken"].value is None and "division" in got["broken"].summary
    assert got["events"].value == 2
    assert got["unplannable"].summary.startswith("error") and 0 <= got["chaos"].value <= 1


def test_python_metrics_step_over_a_match_once_a_task(spark):
    """Matches whose rows lie scattered over the batches are not stepped over batch by batch; null ids are a match."""
    rows = spark.range(4000, numPartitions=2).select(F.when(F.col("id") % 40 > 0, F.concat(F.lit("m"), (F.col("id") % 40).cast("string"))).alias("match_id"), "id")
    steps = spark.sparkContext.accumulator(0)

    def step(n, pdf):
        steps.add(1)
        return n + len(pdf)
    reg = M.MetricRegistry()
    reg.register_python("rows", init=int, step=step, merge=lambda a, b: a + b, finish=lambda n: (n, ""))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = [(r.match_id, r.value) for r in reg.run(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted([(None, 100.0), *((f"m{i}", 100.0) for i in range(1, 40))], key=str)
    assert steps.value <= 2 * (40 + 20)     # 1,600 when every batch holds all matches


def test_decisions_ask_only_for_the_chances_of_results(spark):
    rows = spark.createDataFrame([(380, 0.01, 0.02, 0), (0, 0.1, 0.1, 1), (7, 1.0, 0.0, -2)], "n int, h double, a double, lead int")
    got = rows.select(J.outcome("n", "h", "a", "lead", 0).alias("few"), J.outcome("n", "h", "a", "lead").alias("all"))
    assert got.schema["few"].dataType.names == ["home_win", "draw", "away_win"]
    for r in got.collect():
        assert tuple(r.few) == tuple(r["all"])[:3]


def test_labels_confidence_and_style(spark):
    schema = "player_id string, name string, team string, position string, " + ", ".join(f"{c} long" for c in P.COUNTERS) + ", matches long"
    base = dict(zip(P.COUNTERS, [0] * 11))
    def row(pid, **kw):
        v = {**base, **kw}
        return (pid, pid, "T", "MF", *[v[c] for c in P.COUNTERS], 1)
    rows = [row("thin", actions=59, shots=30), row("fin", actions=100, shots=6), row("cre", actions=200, passes=100, passes_completed=50, key_passes=4),
            row("imp", actions=100, turnovers=4, dribbles=10, dribbles_completed=5), row("con", actions=180, passes=100, passes_completed=90), row("bal", actions=60), row("none")]
    got = {r.player_id: r for r in P.profiles(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.label for k, r in got.items()} == {"thin": "insufficient_data", "fin": "finisher", "cre": "creator", "imp": "impulsive",
                                                     "con": "conservative", "bal": "balanced", "none": "insufficient_data"}
    assert got["bal"].confidence == 0.5 and got["con"].confidence == 0.75 and got["none"].confidence == 0.0
    assert got["fin"].style_shot_frequency == pytest.approx(0.4) and got["none"].style_pass_accuracy == 0.0


def test_on_off_counts_goals_inside_closed_intervals(spark):
    lineups = spark.createDataFrame([("m", "T", "a"), ("m", "T", "b")], "match_id string, team string, player_id string")
    changes = spark.createDataFrame([("m", "T", 1, 60.0, "a", "c"), ("m", "T", 2, 80.0, "b", None)], "match_id string, team string, seq int, minute double, off_id string, on_id string")
    goals = spark.createDataFrame([("m", "T", 10.0), ("m", "T", 60.0), ("m", "T", 85.0)], "match_id string, team string, minute double")
    ends = spark.createDataFrame([("m", 90.0)], "match_id string, match_end double")
    got = {r.player_id: (r.on_min, r.goals_on, r.team_goals) for r in P.on_off(lineups, changes, goals, ends).collect()}
    assert got == {"a": (60.0, 2, 3), "b": (80.0, 2, 3), "c": (30.0, 2, 3)}


def test_tracking_rules(spark):
    schema = "entity string, t double, seq long, x double, y double, name string"
    rows = [("e", 0.0, 0, 10.0, 50.0, "N"), ("e", 2.0, 1, 14.0, 50.0, None), ("e", 2.0, 2, 15.0, 50.0, None), ("fast", 0.0, 0, 0.0, 0.0, None), ("fast", 1.0, 1, 90.0, 0.0, None)]
    df = spark.createDataFrame(rows, schema)
    held = {r.entity: r for r in V.estimate(df, [22.0]).collect()}
    assert (held["e"].x, held["e"].name, held["e"].age) == (15.0, "N", 20.0) and held["e"].confidence == pytest.approx(0.5)
    assert held["e"].vx == pytest.approx(2.0)                            # two sightings at one instant keep the velocity
    assert held["fast"].vx == pytest.approx(11.0)                        # capped
    assert V.estimate(df, [2.0]).where("entity = 'e'").first().observed
    assert V.estimate(df, [123.0]).count() == 0                          # older than two minutes
    moving = V.estimate(df, [3.0], use_velocity=True).where("entity = 'e'").first()
    assert moving.x == pytest.approx(15 + 2 * (0.82 - 1) / math.log(0.82))


def test_upper_median_and_ninetieth(spark):
    errs = spark.createDataFrame([(f"e{i}", float(i), i, float(v), 1.0, 1.0) for i, v in enumerate([5, 1, 1, 3])], "entity string, t double, seq long, error double, static_error double, gap double")
    r = V.evaluation(errs).first()
    assert (r.median_error, r.p90_error, r.mean_error) == (3.0, 5.0, 2.5)


@pytest.mark.parametrize("direction,z,label", [
    ("better", 1.6, "Confirmed"), ("better", 1.0, "Partially confirmed"), ("better", 0.5, "Not confirmed"), ("better", -1.6, "Strongly contradicted"),
    ("worse", -1.6, "Confirmed"), ("same", 0.5, "Confirmed"), ("same", 1.6, "Strongly contradicted"), ("same", 1.5, "Not confirmed")])
def test_verdicts(spark, direction, z, label):
    r = spark.range(1).select(N.verify(F.lit(direction), F.lit(z), F.lit(0.0), F.lit(1.0)).alias("v"),
                              N.verify(F.lit(direction), F.lit(float("nan")), F.lit(0.0), F.lit(1.0)).alias("nan"),
                              N.verify(F.lit(direction), F.lit(z), F.lit(0.0), F.lit(0.0)).alias("flat")).first()
    assert (r.v, r.nan, r.flat) == (label, "Not confirmed", "Not confirmed")
