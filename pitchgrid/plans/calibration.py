"""Scoring, walk-forward fitting and promotion of rate parameters.

One pass turns the snapshot grid into additive score sums per (group, candidate). A fit
is an argmin over those sums, a walk-forward report a prefix sum over blocks, a hold-out
test a lookup; no candidate ever triggers another scan of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.scoring import clip, log_loss, prob_within, ratio, reliability_band, squared_error
from pitchgrid.operators.ordered import first_by, numbered
from pitchgrid.shared import cut
from pitchgrid.plans.snapshots import (
    happened_within, lookup_scale, momentum, regime, snapshot_grid, unit_rates,
)
from pitchgrid.settings import (
    BASE_RATE_GRID, REGIME_MIN_SNAPSHOTS, REGIME_SCALE_GRID, TARGET_SCALE_CLAMP, TAU_GRID, Params,
)

SCORES = ("n", "y_sum", "p_sum", "brier_sum", "ll_sum")


def score_sums(p: Column, y: Column) -> list[Column]:
    return [
        F.count("*").alias("n"), F.sum(y).cast("double").alias("y_sum"), F.sum(p).alias("p_sum"),
        F.sum(squared_error(p, y)).alias("brier_sum"), F.sum(log_loss(p, y)).alias("ll_sum"),
    ]


def score_means(prefix: str = "") -> list[Column]:
    n = F.col(f"{prefix}n")
    return [
        (F.col(f"{prefix}brier_sum") / n).alias("brier"), (F.col(f"{prefix}ll_sum") / n).alias("log_loss"),
        (F.col(f"{prefix}p_sum") / n).alias("mean_pred"), (F.col(f"{prefix}y_sum") / n).alias("base_freq"),
        F.abs((F.col(f"{prefix}p_sum") - F.col(f"{prefix}y_sum")) / n).alias("gap"),
    ]


def evaluate(snapshots: DataFrame, groups: list[str] = []) -> DataFrame:
    """Brier, log loss, mean prediction, base frequency and gap per group."""
    return snapshots.groupBy(*groups).agg(*score_sums(F.col("prob"), F.col("happened"))).select(
        *groups, "n", *score_means())


def reliability(snapshots: DataFrame, bands: int = 10) -> DataFrame:
    """Mean prediction, observed frequency and count per populated band."""
    return snapshots.groupBy(reliability_band(F.col("prob"), bands).alias("band")).agg(
        F.avg("prob").alias("predicted"), F.avg(F.col("happened").cast("double")).alias("observed"),
        F.count("*").alias("n"))


def max_reliability_deviation(snapshots: DataFrame, bands: int = 10) -> DataFrame:
    return reliability(snapshots, bands).agg(
        F.coalesce(F.max(F.abs(F.col("predicted") - F.col("observed"))), F.lit(0.0)).alias("max_deviation"))


# --------------------------------------------------------------------------- #
# Candidate grids
# --------------------------------------------------------------------------- #
def candidate_scores(
    events: DataFrame, groups: DataFrame, group_cols: list[str], start: Params = Params(), *,
    bases: tuple = BASE_RATE_GRID, taus: tuple = TAU_GRID, also: tuple[Params, ...] = (),
    window: int = 10, step: int = 5,
) -> DataFrame:
    """Score sums per (group, candidate).

    ``groups`` maps match_id to the group columns. Candidate 0 is ``start``; 1.. walk the
    grid base-major; -1, -2, .. are ``also``. Pressure is accumulated once per distinct
    tau; candidates are expanded from literals inside the task and summed before the
    shuffle, so nothing but sums travels.
    """
    fixed = [(0, start), *[(-1 - i, p) for i, p in enumerate(also)]]
    all_taus = tuple(dict.fromkeys([*taus, *[p.tau for _, p in fixed]]))
    grid = snapshot_grid(events, start, window=window, step=step, taus=all_taus)
    rows = grid.join(groups.select("match_id", *group_cols), "match_id")
    units = {}
    for i, tau in enumerate(all_taus):
        mom = momentum(F.col(f"press_home_{i}"), F.col(f"press_away_{i}"))
        home, away = unit_rates(mom)
        units[tau] = (home + away) * lookup_scale(regime(mom, start), start.regime_scale)
    def member(cand0, stride, tau, rates):
        return F.struct(F.lit(cand0).alias("first"), F.lit(stride).alias("stride"), F.lit(float(tau)).alias("tau"),
                        F.col(f"__u{all_taus.index(tau)}").alias("unit"),
                        F.array(*[F.lit(float(b)) for b in rates]).alias("bases"))
    members = [member(c, 0, p.tau, (p.base_rate,)) for c, p in fixed]
    members += [member(1 + i, len(taus), tau, bases) for i, tau in enumerate(taus)]
    rows = rows.select(*group_cols, happened_within("goal", window).alias("y"),
                       *[u.alias(f"__u{i}") for i, u in enumerate(units.values())])
    rows = rows.select(*group_cols, "y", F.explode(F.array(*members)).alias("m"))
    rows = rows.select(*group_cols, "y", "m", F.posexplode("m.bases").alias("pos", "base_rate"))
    rows = rows.select(*group_cols, "y", (F.col("m.first") + F.col("pos") * F.col("m.stride")).alias("candidate"),
                       "base_rate", F.col("m.tau").alias("tau"),
                       prob_within(F.col("base_rate") * F.col("m.unit"), window).alias("p"))
    return rows.groupBy(*group_cols, "candidate", "base_rate", "tau").agg(*score_sums(F.col("p"), F.col("y")))


def add_scores(scores: DataFrame, group_cols: list[str]) -> DataFrame:
    return scores.groupBy(*group_cols, "candidate", "base_rate", "tau").agg(*[F.sum(c).alias(c) for c in SCORES])


def best(scores: DataFrame, group_cols: list[str]) -> DataFrame:
    """Lowest log loss per group; the starting point, then grid order, wins ties."""
    ranked = scores.where((F.col("candidate") >= 0) & (F.col("n") > 0))
    return first_by(ranked, group_cols, [F.col("ll_sum") / F.col("n"), F.col("candidate")])


def _in_order(matches: DataFrame, order: list[str]) -> DataFrame:
    """Position of every match along (date, id): ranges of the whole order, numbered by their offsets.

    The ranges are drawn once and stored, so both levels of the numbering read the same ones.
    """
    ranges = cut(matches.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    return numbered(ranges, [], F.col("__range"), [F.col(c) for c in order], "rn", "total").drop("__range")


def folds(matches: DataFrame, n_folds: int, order: list[str]) -> DataFrame:
    """Walk-forward block number per match: block 0 only trains, the tail is dropped.

    ``order`` is a date column followed by text ids.
    """
    ranked = _in_order(matches, order)
    size = F.floor(F.col("total") / (n_folds + 1))
    return (
        ranked.where(size > 0).withColumn("block", F.floor((F.col("rn") - 1) / size).cast("int"))
        .where(F.col("block") <= n_folds).select("match_id", "block")
    )


def walk_forward(scores: DataFrame, n_folds: int) -> DataFrame:
    """Per fold: parameters fitted on all earlier blocks, scored on the next block."""
    earlier = Window.partitionBy("candidate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    table = scores.select("*", *[F.sum(c).over(earlier).alias(f"train_{c}") for c in SCORES]).where("block > 0")
    chosen = first_by(table.where("candidate >= 0 and train_n > 0"), ["block"],
                      [F.col("train_ll_sum") / F.col("train_n"), F.col("candidate")])
    base = table.where("candidate = 0").select(
        "block", *[m.alias("baseline_" + n) for m, n in zip(
            [F.col("brier_sum") / F.col("n"), F.col("ll_sum") / F.col("n")], ["brier", "log_loss"])])
    return chosen.where(F.col("block") <= n_folds).select(
        "block", F.col("base_rate").alias("fitted_base_rate"), F.col("tau").alias("fitted_tau"),
        F.col("train_n"), "n", *score_means()).join(base, "block")


def fit_regime_scale(events: DataFrame, params: Params, *, window: int = 10, step: int = 5,
                     scales: tuple = REGIME_SCALE_GRID, min_snapshots: int = REGIME_MIN_SNAPSHOTS) -> DataFrame:
    """Best rate factor per regime; thin regimes stay at 1.0."""
    grid = snapshot_grid(events, params, window=window, step=step)
    mom = momentum(F.col("press_home_0"), F.col("press_away_0"))
    home, away = unit_rates(mom)
    rows = grid.select(regime(mom, params).alias("regime"), (params.base_rate * (home + away)).alias("lam"),
                       happened_within("goal", window).alias("y"))
    rows = rows.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in (1.0, *scales)])).alias("candidate", "scale"))
    sums = rows.groupBy("regime", "candidate", "scale").agg(
        *score_sums(prob_within(F.col("lam") * F.col("scale"), window), F.col("y")))
    usable = sums.where((F.col("candidate") == 0) | (F.col("n") >= min_snapshots))
    return first_by(usable, ["regime"], [F.col("ll_sum") / F.col("n"), F.col("candidate")]).select(
        "regime", "scale", "n")


def recalibrate(scores: DataFrame) -> DataFrame:
    """Promotion gate over ``candidate_scores`` grouped by ``part`` (train / holdout).

    Candidate -1 holds the active parameters.
    """
    fitted = best(scores.where("part = 'train'"), ["part"]).select("candidate", "base_rate", "tau")
    held = scores.where("part = 'holdout'").select("candidate", (F.col("ll_sum") / F.col("n")).alias("ll"))
    active = held.where("candidate = -1").select(F.col("ll").alias("baseline_log_loss"))
    out = fitted.join(held, "candidate").join(active)
    return out.select("base_rate", "tau", F.col("ll").alias("holdout_log_loss"), "baseline_log_loss",
                      (F.col("ll") <= F.col("baseline_log_loss")).alias("promoted"))


def holdout_parts(matches: DataFrame, order: list[str], share: float = 0.25) -> DataFrame:
    """The newest ``share`` of matches is held out."""
    ranked = _in_order(matches, order)
    cut = F.greatest(F.lit(1), F.floor(F.col("total") * (1 - share)))
    return ranked.select("match_id", F.when(F.col("rn") <= cut, "train").otherwise("holdout").alias("part"))


def active_params(versions: DataFrame, competitions: DataFrame, default: Params = Params()) -> DataFrame:
    """Latest promoted version per competition, else the latest promoted one anywhere."""
    good = versions.where("promoted")
    own = first_by(good, ["competition"], [F.col("id")], largest=True).select(
        "competition", F.col("base_rate").alias("own_rate"), F.col("tau").alias("own_tau"), F.col("id").alias("own_id"))
    anywhere = good.agg(F.max_by(F.struct("base_rate", "tau", "id"), "id").alias("any"))
    return competitions.join(own, "competition", "left").join(F.broadcast(anywhere)).select(
        "competition", F.coalesce("own_id", "any.id").alias("version"),
        F.coalesce("own_rate", "any.base_rate", F.lit(default.base_rate)).alias("base_rate"),
        F.coalesce("own_tau", "any.tau", F.lit(default.tau)).alias("tau"))


def learning_runs(versions: DataFrame, competitions: DataFrame) -> DataFrame:
    """All learning runs, newest first, with the number of ``competitions`` that each one serves now."""
    serving = active_params(versions, competitions).groupBy(F.col("version").alias("id")).agg(F.count("*").alias("serves"))
    return versions.join(serving, "id", "left").withColumn("serves", F.coalesce("serves", F.lit(0))).orderBy(F.desc("id"))


def cross_fit(scores: DataFrame) -> DataFrame:
    """Each competition's fitted candidate scored on every competition's data."""
    fitted = best(scores, ["competition"]).select(F.col("competition").alias("fitted_on"), "candidate", "base_rate", "tau")
    data = scores.select(F.col("competition").alias("scored_on"), "candidate", "n", (F.col("ll_sum") / F.col("n")).alias("log_loss"))
    return fitted.join(data, "candidate").drop("candidate")


def target_benchmark(events: DataFrame, blocks: DataFrame, targets: dict, *, window: int = 10, step: int = 5,
                     params: Params = Params()) -> DataFrame:
    """Constant versus pressure-scaled rate for other event targets, walk-forward."""
    grid = snapshot_grid(events, params, window=window, step=step, targets=targets).join(blocks, "match_id")
    grid = grid.withColumn("pressure", F.col("press_home_0") + F.col("press_away_0"))
    per_match = events.groupBy("match_id").agg(
        (F.floor(F.max("minute")) + 1).alias("minutes"),
        *[F.count_if(F.col("type").isin(*types)).alias(f"n_{n}") for n, types in targets.items()])
    per_block = per_match.join(blocks, "match_id").groupBy("block").agg(
        F.sum("minutes").alias("minutes"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n in targets])
    pressed = grid.groupBy("block").agg(F.sum("pressure").alias("p_sum"), F.count("*").alias("p_n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = list(targets)
    train = per_block.join(pressed, "block").select("block", *[
        (F.sum(f"n_{n}").over(earlier) / F.greatest(F.lit(1.0), F.sum("minutes").over(earlier))).alias(f"rate_{n}")
        for n in names], (F.sum("p_sum").over(earlier) / F.greatest(F.lit(1), F.sum("p_n").over(earlier))).alias("mean_pressure"))
    test = grid.where("block > 0").join(F.broadcast(train), "block")
    scaled = clip(F.col("pressure") / F.col("mean_pressure"), *TARGET_SCALE_CLAMP)
    test = test.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("target"), F.col(f"rate_{n}").alias("rate"), scaled.alias("scale"),
        happened_within(n, window).alias("y")) for n in names])).alias("s")).select("s.*")
    long = test.select("target", "y", F.explode(F.array(
        F.struct(F.lit("constant").alias("model"), prob_within(F.col("rate"), window).alias("p")),
        F.struct(F.lit("scaled").alias("model"), prob_within(F.col("rate") * F.col("scale"), window).alias("p")))).alias("m"))
    return long.groupBy("target", "m.model").agg(*score_sums(F.col("m.p"), F.col("y"))).select(
        "target", "model", "n", *score_means())


def rate_and_pressure(events: DataFrame, types: tuple, *, window: int = 10, step: int = 5) -> DataFrame:
    """Events per minute of play and mean snapshot pressure of a target."""
    grid = snapshot_grid(events, window=window, step=step)
    press = grid.agg(F.avg(F.col("press_home_0") + F.col("press_away_0")).alias("mean_pressure"))
    per_match = events.groupBy("match_id").agg(
        (F.floor(F.max("minute")) + 1).alias("minutes"), F.count_if(F.col("type").isin(*types)).alias("n"))
    rate = per_match.agg(ratio(F.sum("n"), F.sum("minutes")).alias("rate"), F.sum("n").alias("n_events"))
    return rate.join(press)


# --------------------------------------------------------------------------- #
# Learned model
# --------------------------------------------------------------------------- #
FEATURES = ("pressure", "dominance", "clock", "late", "margin", "recent_shots")


def snapshot_features(events: DataFrame, params: Params = Params(), *, window: int = 10, step: int = 5) -> DataFrame:
    """Six leakage-safe features and the outcome per snapshot."""
    grid = snapshot_grid(events, params, window=window, step=step)
    mom = momentum(F.col("press_home_0"), F.col("press_away_0"))
    return grid.select(
        "match_id", F.col("t").alias("minute"),
        (F.col("press_home_0") + F.col("press_away_0")).alias("pressure"),
        F.greatest(mom, 1.0 - mom).alias("dominance"), (F.col("t") / 90.0).alias("clock"),
        F.when(F.col("t") >= 75, 1.0).otherwise(0.0).alias("late"),
        F.abs(F.col("home_goals") - F.col("away_goals")).cast("double").alias("margin"),
        F.col("recent_shots").cast("double").alias("recent_shots"),
        happened_within("goal", window).alias("happened"))


def train_logistic(features: DataFrame, reg: float = 1e-4):
    """Standardised logistic regression fitted by the distributed solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        features.withColumn("label", F.col("happened").cast("double")))
    return LogisticRegression(standardization=True, regParam=reg, maxIter=100).fit(rows)


def training_checks(model, features: DataFrame, reg: float = 1e-4, tolerance: float = 1e-3) -> DataFrame:
    """Facts that hold for a finished fit: rows and goals of the training data, whether the gradient of the penalised
    log loss vanishes there (per standardised feature and for the intercept), and whether the log loss is at most that
    of the constant base rate. One aggregate; the model's few numbers are literals.
    """
    y, names = F.col("happened").cast("double"), list(FEATURES)
    scored = score_logistic(model, features)
    off = F.col("prob") - y
    sums = scored.agg(
        F.count("*").alias("n"), F.sum(y).cast("long").alias("n_happened"), F.avg(off).alias("g_all"), F.avg(y).alias("rate"),
        F.avg(log_loss(F.col("prob"), y)).alias("loss"), *[F.avg(off * F.col(c)).alias(f"g_{c}") for c in names], *[F.stddev(c).alias(f"s_{c}") for c in names])
    slopes = [F.abs(F.when(F.col(f"s_{c}") > 0, F.col(f"g_{c}") / F.col(f"s_{c}") + reg * float(b) * F.col(f"s_{c}")).otherwise(0.0))
              for c, b in zip(names, model.coefficients)]
    constant = -(F.col("rate") * F.log("rate") + (1 - F.col("rate")) * F.log(1 - F.col("rate")))
    return sums.select("n", "n_happened", (F.greatest(F.abs("g_all"), *slopes) < tolerance).alias("stationary"), (F.col("loss") <= constant + 1e-9).alias("beats_constant"))


def score_logistic(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")
