"""Walk-forward 1X2 models: trailing shares, attack/defence Poisson, Elo, odds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.scoring import (
    implied_probabilities, multiclass_brier, multiclass_log_loss, outcome_index, poisson_pmf,
)
from pitchgrid.operators.ordered import running_sums
from pitchgrid.settings import (
    BURN_IN, ELO_BASE, ELO_HOME, ELO_K, LEAGUE_AWAY_GOALS, LEAGUE_HOME_GOALS, MAX_GOALS, PRIOR_MATCHES,
)

LEAGUE = ["league", "season"]


def _bucket() -> Column:
    """Rises along (date, seq); splits a date that holds very many matches."""
    return F.struct("date", F.floor(F.col("seq") / 100_000))


def _before(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals over strictly earlier rows in (date, seq) order, two-level over dates."""
    return running_sums(df, keys, _bucket(), [F.col("date"), F.col("seq")], sums, inclusive=False)


def trailing_frequencies(fixtures: DataFrame) -> DataFrame:
    """Laplace-smoothed home/draw/away shares of all earlier matches of the league season."""
    o = outcome_index(F.col("home_goals"), F.col("away_goals"))
    run = _before(fixtures.withColumn("actual", o), LEAGUE, {
        f"c{i}": (F.col("actual") == i).cast("bigint") for i in range(3)})
    total = F.col("c0") + F.col("c1") + F.col("c2") + 3.0
    return run.select(*fixtures.columns, "actual", (F.col("c0") + F.col("c1") + F.col("c2") + 1).alias("match_no"),
                      *[((F.col(f"c{i}") + 1.0) / total).alias(f"naive_{n}") for i, n in enumerate("hda")])


def attack_defence(fixtures: DataFrame, prior: float = PRIOR_MATCHES, max_goals: int = MAX_GOALS) -> DataFrame:
    """Attack/defence rates from earlier matches only, shrunk to the league mean.

    No loop: team totals and league totals are running sums that stop before the match.
    """
    both = fixtures.select(*LEAGUE, "seq", "date", F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home").alias("team"), F.col("home_goals").alias("gf"), F.col("away_goals").alias("ga")),
        F.struct(F.lit("away").alias("side"), F.col("away").alias("team"), F.col("away_goals").alias("gf"), F.col("home_goals").alias("ga")))).alias("s")).select(
        *LEAGUE, "seq", "date", "s.*")
    form = _before(both, [*LEAGUE, "team"], {"scored": F.col("gf"), "conceded": F.col("ga"), "played": F.lit(1)})
    wide = form.groupBy(*LEAGUE, "seq").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in ("scored", "conceded", "played")])
    league = _before(fixtures, LEAGUE, {"sum_home": F.col("home_goals"), "sum_away": F.col("away_goals"), "n_before": F.lit(1)})
    j = league.join(wide, [*LEAGUE, "seq"])
    n = F.col("n_before")
    home_avg = F.when(n == 0, LEAGUE_HOME_GOALS).otherwise(F.try_divide(F.col("sum_home"), n))
    away_avg = F.when(n == 0, LEAGUE_AWAY_GOALS).otherwise(F.try_divide(F.col("sum_away"), n))
    overall = (home_avg + away_avg) / 2.0

    def strength(side, what):
        played = F.col(f"{side}_played")
        raw = F.col(f"{side}_{what}") / F.greatest(F.lit(1), played) / overall
        return F.when(overall <= 0, 1.0).otherwise((raw * played + prior) / (played + prior))
    j = j.withColumn("lam_home", home_avg * strength("home", "scored") * strength("away", "conceded")).withColumn(
        "lam_away", away_avg * strength("away", "scored") * strength("home", "conceded"))
    # One column a goal count, so that the grid is sums of products in generated code.
    counts = range(max_goals + 1)
    j = j.withColumns({f"p{s}{k}": poisson_pmf(F.col(f"lam_{side}"), F.lit(k)) for s, side in (("h", "home"), ("a", "away")) for k in counts})
    add = lambda cols: reduce(lambda x, y: x + y, cols, F.lit(0.0))
    j = j.withColumns({f"below{k}": add(F.col(f"pa{i}") for i in range(k)) for k in range(max_goals + 2)})
    draw = add(F.col(f"ph{k}") * F.col(f"pa{k}") for k in counts)
    home = add(F.col(f"ph{k}") * F.col(f"below{k}") for k in counts)
    whole = add(F.col(f"ph{k}") for k in counts) * F.col(f"below{max_goals + 1}")
    j = j.withColumn("d0", draw / whole).withColumn("h0", home / whole)
    return j.select(*LEAGUE, "seq", "lam_home", "lam_away", F.col("h0").alias("poisson_h"), F.col("d0").alias("poisson_d"),
                    (1.0 - F.col("h0") - F.col("d0")).alias("poisson_a"))


def elo(fixtures: DataFrame, *, k: float = ELO_K, home_adv: float = ELO_HOME, base: float = ELO_BASE) -> DataFrame:
    """Home win expectation before every match, ratings updated after it.

    A league season is inherently sequential; leagues run in parallel. Each is one pass over its matches in order, which
    stream through the task: it holds the ratings, a number a team, and a batch of rows, however long a league is.
    """
    ordered = fixtures.select(*LEAGUE, "date", "seq", "home", "away", "home_goals", "away_goals").repartition(*LEAGUE).sortWithinPartitions(*LEAGUE, "date", "seq")
    rows = ordered.select(*LEAGUE, "seq", "home", "away", "home_goals", "away_goals")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        league, rating = None, {}
        for batch in batches:
            expectations = []
            for *own, h, a, hg, ag in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
                if own != league:
                    league, rating = own, {}
                rh, ra = rating.get(h, base), rating.get(a, base)
                expected = 1.0 / (1.0 + 10.0 ** (-(rh + home_adv - ra) / 400.0))
                expectations.append(expected)
                delta = k * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - expected)
                rating[h] = rh + delta
                rating[a] = rating.get(a, base) - delta
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(expectations, pa.float64())], names=[*LEAGUE, "seq", "expected_home"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(walk, ", ".join([*(f"{c} {kinds[c]}" for c in (*LEAGUE, "seq")), "expected_home double"]))


def predictions(fixtures: DataFrame) -> DataFrame:
    """All four models' probabilities beside the result, one row per match."""
    naive = trailing_frequencies(fixtures)
    j = naive.join(attack_defence(fixtures), [*LEAGUE, "seq"]).join(elo(fixtures), [*LEAGUE, "seq"])
    e, d = F.col("expected_home"), F.least(F.greatest(F.col("naive_d"), F.lit(0.0)), F.lit(0.9))
    odds = implied_probabilities([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])
    return j.select("*", (e * (1 - d)).alias("elo_h"), d.alias("elo_d"), ((1 - e) * (1 - d)).alias("elo_a"),
                    *[p.alias(f"odds_p{n}") for p, n in zip(odds, "hda")])


MODELS = {"naive": "naive_{}", "elo": "elo_{}", "poisson": "poisson_{}", "odds": "odds_p{}"}


def benchmark(predicted: DataFrame, burn_in: int = BURN_IN) -> DataFrame:
    """Mean multiclass Brier and log loss per model after the burn-in of each league season."""
    rows = predicted.where(F.col("match_no") > burn_in)
    long = rows.select("actual", F.explode(F.array(*[F.struct(
        F.lit(m).alias("model"), *[F.col(t.format(n)).alias(n) for n in "hda"]) for m, t in MODELS.items()])).alias("p")).select("actual", "p.*")
    probs = [F.col("h"), F.col("d"), F.col("a")]
    return long.groupBy("model").agg(F.count("*").alias("n"), F.avg(multiclass_brier(probs, F.col("actual"))).alias("brier"),
                                     F.avg(multiclass_log_loss(probs, F.col("actual"))).alias("log_loss"))
