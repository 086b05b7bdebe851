"""Game state: every boundary rule, leakage, skew-free plan."""

import math

import pytest
from pyspark.sql import functions as F

from pitchgrid.plans import calibration as C
from pitchgrid.plans import snapshots as S
from pitchgrid.settings import EVENT_WEIGHTS, Params


def _panel(df, minute, match="m", **kw):
    return {r.match_id: r for r in S.panel(df, last=F.lit(120), **kw).where(F.col("minute") == minute).collect()}[match]


@pytest.mark.parametrize("minute,rows,expected", [
    (40, [("m", m, s, "shot") for m, s in zip((36, 37, 38, 39), ("HOME", "AWAY") * 2)], "NORMAL"),
    (40, [("m", 35 + 0.9 * i, "HOME", "shot") for i in range(6)], "PRESSURE"),
    (44, [("m", 42, "HOME", "goal")], "POST_GOAL"),
    (47, [("m", 42, "HOME", "goal")], "NORMAL"),                       # exactly five minutes later
    (52, [("m", 50, "AWAY", "red_card")], "POST_RED_CARD"),
    (60, [("m", 50, "AWAY", "red_card")], "POST_RED_CARD"),            # ten minutes are included
    (61, [("m", 50, "AWAY", "red_card")], "NORMAL"),
    (85, [("m", 20, "HOME", "goal"), ("m", 30, "AWAY", "goal"), ("m", 70, "HOME", "shot")], "END_GAME"),
    (85, [("m", 20, "AWAY", "goal"), ("m", 70, "HOME", "shot")], "DESPERATION"),
    (80, [("m", 20, "AWAY", "goal"), ("m", 79, "HOME", "corner"), ("m", 79, "AWAY", "corner")], "NORMAL"),
    (86, [("m", 85, "HOME", "goal")], "POST_GOAL"),
])
def test_regimes(events, minute, rows, expected):
    assert _panel(events(rows), minute).regime == expected


def test_pressure_is_the_decayed_sum_including_ties(events):
    rows = [("m", 10, "HOME", "shot"), ("m", 12.5, "HOME", "shot_on_target"), ("m", 20, "HOME", "corner"), ("m", 20.01, "HOME", "shot"),
            ("m", 3, "AWAY", "dangerous_attack"), ("m", 19, "AWAY", "foul")]
    p = _panel(events(rows), 20)
    want = lambda side: sum(EVENT_WEIGHTS.get(t, 0) * math.exp(-(20 - m) / 8) for _, m, s, t in rows if s == side and m <= 20)
    assert p.pressure_home == pytest.approx(want("HOME"), abs=1e-12)
    assert p.pressure_away == pytest.approx(want("AWAY"), abs=1e-12)
    assert p.momentum == pytest.approx(want("HOME") / (want("HOME") + want("AWAY")))
    assert p.n_events == 5


def test_balanced_without_pressure_and_recent_shots_include_both_ends(events):
    p = _panel(events([("m", 5, "HOME", "foul")]), 6)
    assert p.momentum == 0.5 and p.next_goal_home == pytest.approx(0.5)
    df = events([("m", 10, "HOME", "shot"), ("m", 20, "AWAY", "shot_on_target"), ("m", 9.99, "HOME", "shot")])
    assert _panel(df, 20).recent_shots == 2 and _panel(df, 21).recent_shots == 1


def test_outcome_window_is_open_on_the_left(events):
    df = events([("m", 15, "HOME", "goal"), ("m", 94, "HOME", "pass")])
    got = {r.minute: r.happened for r in S.snapshots(df).collect()}
    assert got[5] == 1 and got[10] == 1 and got[15] == 0
    assert max(got) == 85                                              # 95 minutes leave a full window


def test_rates_follow_the_multipliers(events):
    df = events([("m", 10, "HOME", "goal"), ("m", 20, "AWAY", "red_card")])
    p = _panel(df, 30)
    clock = 1 + 0.4 * math.exp(-15 / 6)
    assert p.lam_home == pytest.approx(0.015 * 1.0 * 0.9 * clock * 1.2)
    assert p.lam_away == pytest.approx(0.015 * 1.0 * 1.1 * clock * 0.85)
    assert p.goal_next_10min == pytest.approx(1 - math.exp(-10 * (p.lam_home + p.lam_away)))
    assert p.goal_before_half == pytest.approx(1 - math.exp(-15 * (p.lam_home + p.lam_away)))


def test_transition_softens_confidence(events):
    df = events([("m", 0.2 * i, "HOME" if i % 2 else "AWAY", "foul") for i in range(100)] + [("m", 42, "HOME", "goal")])
    calm, shaken = _panel(df, 41), _panel(df, 43)
    assert calm.instability == 0.0 and shaken.instability == 0.6
    assert shaken.confidence == pytest.approx((0.95 * 0.4) ** 0.2)
    assert shaken.because[0] == "the game shifted at minute 43"


def test_headers_give_matches_without_events_a_grid(spark, events):
    heads = spark.createDataFrame([("m", 95), ("empty", 40)], "match_id string, duration int")
    got = S.snapshots(events([("m", 3, "HOME", "goal")]), headers=heads).groupBy("match_id").agg(F.max("minute").alias("t")).collect()
    assert {r.match_id: r.t for r in got} == {"m": 85, "empty": 30}


def test_erasing_the_future_changes_nothing(events):
    rows = [(f"m{k}", 7.3 * i + k, "HOME" if (i + k) % 2 else "AWAY", t) for k in range(3)
            for i, t in enumerate(["shot", "goal", "corner", "red_card", "shot_on_target", "goal", "foul", "shot"])]
    audit = S.leakage_audit(events(rows), [10, 20, 40, 60]).collect()
    assert len(audit) == 12 and all(r.variants == 1 and r.n == 2 for r in audit)


def test_events_are_combined_before_the_shuffle(events):
    """The only exchange of event rows carries per-(match, cell) partial aggregates."""
    plan = S.panel(events([("m", 3, "HOME", "goal")]))._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(keys) == 2 and sum("cell" in k for k in keys) == 1
    assert "partial_count" in plan or "partial_sum" in plan


def test_result_does_not_depend_on_partitions(events):
    rows = [("m", i * 0.9, "HOME" if i % 3 else "AWAY", ["shot", "corner", "goal"][i % 3]) for i in range(100)]
    a, b = events(rows), events(rows).repartition(13)
    key = lambda df: [(r.minute, r.regime, round(r.momentum, 9), round(r.confidence, 9)) for r in S.panel(df).orderBy("minute").collect()]
    assert key(a) == key(b)


def test_fit_keeps_the_start_on_ties_and_walks_forward(spark, events):
    rows = [(f"m{k}", 1.0 + 9 * i, "HOME", "goal" if i % 4 == 0 else "shot") for k in range(10) for i in range(10)]
    df = events(rows)
    groups = spark.createDataFrame([(f"m{k}", "g") for k in range(10)], "match_id string, g string")
    same = C.candidate_scores(df, groups, ["g"], bases=(0.015,), taus=(8.0,))
    assert C.best(same, ["g"]).first().candidate == 0
    heads = spark.createDataFrame([(f"m{k}", f"2024-01-{k + 1:02d}") for k in range(10)], "match_id string, d string")
    blocks = {r.match_id: r.block for r in C.folds(heads, 3, ["d", "match_id"]).collect()}
    assert blocks == {f"m{k}": k // 2 for k in range(8)}               # two tail matches are unused
    parts = {r.match_id: r.part for r in C.holdout_parts(heads, ["d", "match_id"]).collect()}
    assert [parts[f"m{k}"] for k in range(10)] == ["train"] * 7 + ["holdout"] * 3


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 1), (1.0, 1), (0.25, 1)], "prob double, happened int")
    r = C.evaluate(df).first()
    assert r.brier == pytest.approx((0.04 + 0.01 + 0 + 0.5625) / 4)
    assert r.log_loss == pytest.approx(-(math.log(0.8) + math.log(0.9) + math.log(1 - 1e-15) + math.log(0.25)) / 4)
    assert {b.band: b.n for b in C.reliability(df).collect()} == {2: 2, 9: 2}


def test_regime_scale_leaves_thin_regimes_alone(events):
    df = events([("m", 5 + 3 * i, "HOME", "goal") for i in range(25)])
    assert {r.scale for r in C.fit_regime_scale(df, Params()).collect()} == {1.0}


def test_a_hot_match_is_reduced_to_its_clock(spark):
    """A third of all events in one match: at most one row per grid minute leaves a map task."""
    from pitchgrid.operators.grid import game_cells
    kind = F.element_at(F.array(*[F.lit(k) for k in ("shot", "corner", "foul", "goal")]), (F.col("id") % 4 + 1).cast("int"))
    side = F.when(F.col("id") % 3 == 0, "HOME").otherwise("AWAY")
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 500).cast("string"))).alias("match_id"),
        (F.col("id") * 7919 % 95_000 / 1000.0).alias("minute"), side.alias("team"), kind.alias("type"))
    cells = game_cells(df, 1, (8.0,), {})
    assert cells.where("match_id = 'hot'").count() <= 96
    got = S.panel(df).where("match_id = 'hot' AND minute = 60").first()
    rows = df.where("match_id = 'hot' AND minute <= 60").collect()
    for name, want in (("HOME", got.pressure_home), ("AWAY", got.pressure_away)):
        brute = math.fsum(EVENT_WEIGHTS.get(r.type, 0) * math.exp((r.minute - 60) / 8) for r in rows if r.team == name)
        assert want == pytest.approx(brute, rel=1e-9)
    assert got.n_events == len(rows)
