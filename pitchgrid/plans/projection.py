"""Outcome projection in closed form, lane windows, decision ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.clock import lane
from pitchgrid.functions.scoring import multiclass_brier
from pitchgrid.operators.grid import game_cells, game_grid
from pitchgrid.plans.snapshots import read_state
from pitchgrid.settings import APPROACHES, ATTACK_TYPES, LANES, RECOMMEND_MIN_GAIN, Params

TOP_COUNTS = 6
GRID_CELLS = 100_000     # probabilities held at once by a task; wider states take fewer rows at a time


def _lane_sums(tau: float) -> dict:
    """Decayed located attacking actions per side and lane."""
    out = {}
    for side in ("home", "away"):
        for name in LANES:
            hit = F.col("type").isin(*ATTACK_TYPES) & (F.col("team") == side.upper()) & (lane(F.col("y")) == name)
            out[f"lane_{side}_{name}"] = (F.when(hit, 1.0).otherwise(0.0), tau)
    return out


def lane_states(events: DataFrame, params: Params = Params(), *, step: int = 5, last: Column | None = None,
                headers: DataFrame | None = None) -> DataFrame:
    """Game state with each side's lane shares (uniform before the first located attack)."""
    extra = _lane_sums(params.tau)
    cells = game_cells(events, step, (params.tau,), {}, extra)
    state = read_state(game_grid(cells, step, (params.tau,), {}, last, headers, extra), params)
    for side in ("home", "away"):
        total = sum((F.col(f"lane_{side}_{n}") for n in LANES[1:]), F.col(f"lane_{side}_{LANES[0]}"))
        state = state.select("*", *[
            F.when(total > 0, F.col(f"lane_{side}_{n}") / total).otherwise(F.lit(1.0 / 3)).alias(f"share_{side}_{n}")
            for n in LANES])
    return state


def with_slices(states: DataFrame, step_seconds: float = 15.0, mult: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Add the horizon, its number of time slices and the goal chance per slice."""
    step = step_seconds / 60.0
    horizon = F.greatest(F.lit(0.0), F.col("duration") - F.col("t"))
    return states.withColumn("horizon", horizon.cast("double")).withColumn(
        "slices", F.when(F.col("horizon") > 0, F.greatest(F.lit(1), F.ceil(F.col("horizon") / step))).otherwise(0).cast("int")
    ).withColumn("p_home", F.least(F.lit(1.0), F.col("lam_home") * mult[0] * step)).withColumn(
        "p_away", F.least(F.lit(1.0), F.col("lam_away") * mult[1] * step))


RESULT = "home_win double, draw double, away_win double"
OUTCOME = RESULT + ", home_k array<int>, home_p array<double>, away_k array<int>, away_p array<double>"


def _pmf(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows of P(X = 0..max n), X ~ Binomial(n, p), summed up in logarithms."""
    k = np.arange(1, n.max(initial=0) + 1)
    certain = p >= 1.0
    q = np.where(certain, 0.0, p)
    with np.errstate(divide="ignore"):
        step = np.log(np.maximum(0, n[:, None] - k + 1) / k) + (np.log(q) - np.log1p(-q))[:, None]
    out = np.exp(np.column_stack([np.zeros(len(n)), np.cumsum(step, axis=1)]) + (n * np.log1p(-q))[:, None])
    out[certain] = np.arange(len(k) + 1) == n[certain][:, None]
    return out


def _result_chances(home: np.ndarray, away: np.ndarray, lead: np.ndarray) -> dict[str, np.ndarray]:
    """Chances of the three results from the chances of every remaining goal count of both sides."""
    most = home.shape[1] - 1
    level = np.arange(most + 1) + lead[:, None]     # away goals for a draw
    at = lambda m, k: np.where((k >= 0) & (k <= most), np.take_along_axis(m, np.clip(k, 0, most), 1), 0.0)
    upto = np.cumsum(away, axis=1)
    fewer = np.where(level > most, upto[:, -1:], at(upto, level - 1))
    more = np.where(level < 0, upto[:, -1:], np.where(level >= most, 0.0, upto[:, -1:] - at(upto, level)))
    return {"home_win": (home * fewer).sum(axis=1), "draw": (home * at(away, level)).sum(axis=1), "away_win": (home * more).sum(axis=1)}


def _outcome_rows(n: np.ndarray, p_home: np.ndarray, p_away: np.ndarray, lead: np.ndarray, top: int) -> pd.DataFrame:
    """Result chances and, unless ``top`` is 0, the likeliest goal counts of both sides, over every count that the slices allow."""
    home, away = _pmf(n, p_home), _pmf(n, p_away)
    out = _result_chances(home, away, lead)
    if top:
        for side, chances in (("home", home), ("away", away)):
            best = np.argsort(-chances, axis=1, kind="stable")[:, :top].astype(np.int32)
            out |= {f"{side}_k": list(best), f"{side}_p": list(np.take_along_axis(chances, best, 1))}
    return pd.DataFrame(out)


def _outcome_batch(top: int):
    """Arrow-batched numpy: some forty array operations per batch, where folding arrays row by row
    inside SQL expressions costs about a hundred times as much."""
    def run(n: pd.Series, p_home: pd.Series, p_away: pd.Series, lead: pd.Series) -> pd.DataFrame:
        cols = n.to_numpy(np.int64), p_home.to_numpy(float), p_away.to_numpy(float), lead.to_numpy(np.int64)
        rows = max(1, GRID_CELLS // (int(cols[0].max(initial=0)) + 1))
        parts = [_outcome_rows(*(c[i:i + rows] for c in cols), top) for i in range(0, max(len(n), 1), rows)]
        return pd.concat(parts, ignore_index=True)
    return run


def outcome(slices, p_home, p_away, lead, top: int = TOP_COUNTS) -> Column:
    return F.pandas_udf(_outcome_batch(top), OUTCOME if top else RESULT)(slices, p_home, p_away, lead)


def project(sliced: DataFrame, top: int = TOP_COUNTS) -> DataFrame:
    """Outcome distribution, expected goals and goal chances for the remaining time."""
    n = F.col("slices")
    s = sliced.withColumn("o", outcome("slices", "p_home", "p_away", F.col("home_goals") - F.col("away_goals"), top))
    none_home, none_away = F.pow(1.0 - F.col("p_home"), n), F.pow(1.0 - F.col("p_away"), n)
    return s.withColumn("home_win", F.col("o.home_win")).withColumn("draw", F.col("o.draw")).withColumn(
        "away_win", F.col("o.away_win")).withColumn(
        "expected_home", n * F.col("p_home")).withColumn("expected_away", n * F.col("p_away")).withColumn(
        "goal_home", 1.0 - none_home).withColumn("goal_away", 1.0 - none_away).withColumn(
        "goal_any", 1.0 - none_home * none_away)


def scorelines(sliced: DataFrame, k: int = TOP_COUNTS) -> DataFrame:
    """The k likeliest remaining scorelines of each state.

    A scoreline in the top k combines goal counts that are each in the top k of their own
    side, so k x k cells are enough.
    """
    side = lambda s: F.arrays_zip(F.col(f"o.{s}_k").alias("k"), F.col(f"o.{s}_p").alias("p"))
    cells = F.flatten(F.transform(side("home"), lambda h: F.transform(side("away"), lambda a: F.struct(
        (-(h.p * a.p)).alias("np"), h.k.alias("home"), a.k.alias("away")))))
    ranked = project(sliced.where("slices > 0"), k).select("match_id", "t", F.posexplode(F.slice(F.array_sort(cells), 1, k)).alias("rank", "c"))
    return ranked.select("match_id", F.col("t").alias("minute"), (F.col("rank") + 1).alias("rank"), F.col("c.home").alias("home"),
                         F.col("c.away").alias("away"), (-F.col("c.np")).alias("prob"))


def lane_windows(sliced: DataFrame, step_seconds: float = 15.0, floor: float = 0.05) -> DataFrame:
    """Chance that a lane opens before the end and the median time to it (geometric), likeliest and then soonest first.

    The six windows of a state stand in its row, so ranking them needs no shuffle.
    """
    def opening(side, name):
        q = F.col(f"p_{side}") * F.col(f"share_{side}_{name}")
        prob = 1.0 - F.pow(1.0 - q, F.col("slices"))
        median = F.greatest(F.lit(0), F.ceil(F.try_divide(F.log(1.0 - prob / 2), F.log(1.0 - q))) - 1) * step_seconds
        return F.struct((-F.round(prob, 9)).alias("order"), median.cast("double").alias("eta_seconds"), F.lit(side.upper()).alias("team"),
                        F.lit(name).alias("lane"), prob.alias("probability"))
    every = F.array(*[opening(side, n) for side in ("home", "away") for n in LANES])
    ranked = F.array_sort(F.filter(every, lambda w: w.probability >= floor))
    rows = sliced.where("slices > 0").select("match_id", F.col("t").alias("minute"), F.posexplode(ranked).alias("place", "w"))
    return rows.select("match_id", "minute", (F.col("place") + 1).alias("rank"), "w.team", "w.lane", "w.probability", "w.eta_seconds",
                       F.lit(step_seconds).alias("window_seconds"))


def rank_decisions(states: DataFrame, side: str, step_seconds: float = 15.0) -> DataFrame:
    """Win chance of each approach against keeping the shape, with a recommendation.

    The four approaches are columns of the same row, so ranking them needs no shuffle.
    """
    step = step_seconds / 60.0
    s = with_slices(states, step_seconds)
    lead = F.col("home_goals") - F.col("away_goals")
    for name, own, opp in APPROACHES:
        mh, ma = (own, opp) if side == "HOME" else (opp, own)
        s = s.withColumn(f"o_{name}", outcome(
            "slices", F.least(F.lit(1.0), F.col("lam_home") * mh * step), F.least(F.lit(1.0), F.col("lam_away") * ma * step), lead, 0))

    def chances(name):
        home, draw, away = (F.col(f"o_{name}.{c}") for c in ("home_win", "draw", "away_win"))
        win, loss = (home, away) if side == "HOME" else (away, home)
        return F.struct(F.lit(name).alias("approach"), win.alias("win"), draw.alias("draw"), loss.alias("loss"))
    s = s.select("match_id", "t", F.array(*[chances(n) for n, _, _ in APPROACHES]).alias("all"))
    keep = F.element_at(F.filter("all", lambda a: a.approach == "keep"), 1).win
    top = F.array_max(F.transform("all", lambda a: F.struct(F.round(a.win, 9).alias("w"), a.approach.alias("approach"), a.win.alias("win"))))
    s = s.select("match_id", "t", "all", keep.alias("keep_win"), top.alias("top"))
    advice = F.when(F.col("top.win") - F.col("keep_win") > RECOMMEND_MIN_GAIN, F.col("top.approach")).otherwise("keep")
    return s.select("match_id", F.col("t").alias("minute"), "keep_win", advice.alias("recommended"), F.explode("all").alias("a")).select(
        "match_id", "minute", "a.*", (F.col("a.win") - F.col("keep_win")).alias("delta_win"), "recommended")


def checkpoint_accuracy(projected: DataFrame, truth: DataFrame, shares: DataFrame) -> DataFrame:
    """Projection against 'score persists' and constant baselines per checkpoint.

    ``truth(match_id, actual 0/1/2)``; ``shares(home_win, draw, away_win)`` is one row.
    """
    const = shares.select(F.array("home_win", "draw", "away_win").alias("const"))
    j = projected.join(truth, "match_id").join(F.broadcast(const))
    lead = F.signum((F.col("home_goals") - F.col("away_goals")).cast("double"))
    stays = F.when(lead > 0, 0).when(lead == 0, 1).otherwise(2)
    model = [F.col("home_win"), F.col("draw"), F.col("away_win")]
    keep = [(stays == i).cast("double") for i in range(3)]
    flat = [F.element_at("const", i + 1) for i in range(3)]
    actual = F.col("actual")
    near = [F.round(m, 9) for m in model]      # equal chances go to the earlier outcome
    pick = F.when((near[0] >= near[1]) & (near[0] >= near[2]), 0).when(near[1] >= near[2], 1).otherwise(2)
    return j.groupBy(F.col("t").alias("minute")).agg(
        F.count("*").alias("n"), F.avg((pick == actual).cast("double")).alias("accuracy"),
        F.avg(multiclass_brier(model, actual)).alias("brier"),
        F.avg((stays == actual).cast("double")).alias("persist_accuracy"), F.avg(multiclass_brier(keep, actual)).alias("persist_brier"),
        F.avg(multiclass_brier(flat, actual)).alias("constant_brier"),
        F.avg(F.element_at(F.array(*model), actual + 1)).alias("p_true"))
