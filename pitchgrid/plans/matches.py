"""Whole-match analytics: leads, presets, quality, vectors, story, counterfactuals."""

from __future__ import annotations

import pickle
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.scoring import ratio
from pitchgrid.operators.grid import game_cells, game_grid
from pitchgrid.operators.ordered import first_by, numbered, running_sums
from pitchgrid.operators.skew import salted_join
from pitchgrid.plans.snapshots import momentum, panel, percent
from pitchgrid.settings import (
    CARD_STORM_CARDS, CARD_TYPES, CHAOS_LEVELS, CHAOS_WEIGHTS, CHECKPOINTS, COMEBACK_LEAD, GOAL_BINS, GOAL_FEST_GOALS,
    LATE_DRAMA_MARGIN, SHOT_TYPES, SWING, VECTOR_SCALES, Params,
)


def goal_sequence(events: DataFrame) -> DataFrame:
    """Every goal with the goal difference after it and the leader before and after.

    Needs a unique event_id. The running score is a two-level sum over minutes.
    """
    goals = events.where("type = 'goal'").select("match_id", "event_id", "minute", "team").withColumn(
        "delta", F.when(F.col("team") == "HOME", 1).otherwise(-1))
    run = running_sums(goals, ["match_id"], F.floor(F.col("minute") * 6), [F.col("minute"), F.col("event_id")],
                       {"diff": F.col("delta")})
    sign = lambda c: F.signum(c.cast("double")).cast("int")
    return run.withColumn("leader", sign(F.col("diff"))).withColumn("leader_before", sign(F.col("diff") - F.col("delta")))


def match_facts(events: DataFrame) -> DataFrame:
    """One row per match: goals, cards, shots, goal bins, leads and lead changes."""
    kind, m = F.col("type"), F.col("minute")
    goal = kind == "goal"
    counts = events.groupBy("match_id").agg(
        F.count("*").alias("n_events"), F.max("minute").alias("last_minute"),
        F.count_if(goal).alias("goals"), F.count_if(goal & (F.col("team") == "HOME")).alias("home_goals"),
        F.count_if(goal & (F.col("team") == "AWAY")).alias("away_goals"),
        F.count_if(goal & (m >= 85)).alias("goals_from_85"), F.count_if(goal & (m >= 80)).alias("goals_from_80"),
        F.count_if(kind.isin(*SHOT_TYPES)).alias("shots"), F.count_if(kind == "corner").alias("corners"),
        F.count_if(kind.isin(*CARD_TYPES)).alias("cards"), F.count_if(kind == "red_card").alias("reds"),
        *[F.count_if(goal & (m >= lo) & (m < hi)).alias(f"goals_{lo}_{hi}") for lo, hi in GOAL_BINS])
    leads = goal_sequence(events).groupBy("match_id").agg(
        F.greatest(F.lit(0), F.max("diff")).alias("max_home_lead"),
        F.greatest(F.lit(0), F.max(-F.col("diff"))).alias("max_away_lead"),
        F.count_if((F.col("leader") != F.col("leader_before")) & (F.col("leader") != 0)).alias("lead_changes"))
    out = counts.join(leads, "match_id", "left")
    return out.fillna(0, ["max_home_lead", "max_away_lead", "lead_changes"])


def presets(facts: DataFrame) -> DataFrame:
    """Five cross-match queries in one pass: one row per (match, preset) that applies."""
    c = F.col
    diff = c("home_goals") - c("away_goals")
    home_lost = (c("max_home_lead") >= COMEBACK_LEAD) & (diff <= 0)
    away_lost = (c("max_away_lead") >= COMEBACK_LEAD) & (diff >= 0)
    rules = {
        "comebacks": home_lost | away_lost, "blown_leads": home_lost | away_lost,
        "goal_fests": c("goals") >= GOAL_FEST_GOALS,
        "late_drama": (c("goals_from_85") > 0) & (F.abs(diff) <= LATE_DRAMA_MARGIN), "card_storms": c("cards") >= CARD_STORM_CARDS,
    }
    stat = {
        "comebacks": F.when(c("max_home_lead") >= COMEBACK_LEAD, "AWAY").otherwise("HOME"),
        "blown_leads": F.when(home_lost, F.concat(F.lit("HOME +"), c("max_home_lead").cast("string"))).otherwise(
            F.concat(F.lit("AWAY +"), c("max_away_lead").cast("string"))),
        "goal_fests": c("goals").cast("string"), "late_drama": c("goals_from_85").cast("string"),
        "card_storms": c("cards").cast("string"),
    }
    made = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(n).alias("preset"), stat[n].alias("stat"))) for n, cond in rules.items()]))
    return facts.select("match_id", F.explode(made).alias("p")).select("match_id", "p.*")


def quality_issues(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Every data-quality problem of every match; no row = clean."""
    j = matches.join(facts.select("match_id", "n_events", "last_minute", F.col("home_goals").alias("h"), F.col("away_goals").alias("a")), "match_id", "left")
    empty = F.col("n_events").isNull()
    wrong = ~empty & ((F.col("home_goals_final") != F.col("h")) | (F.col("away_goals_final") != F.col("a")))
    return j.select("match_id", F.explode(F.array_compact(F.array(
        F.when(empty, "no events"),
        F.when(wrong, F.format_string("goal events %d-%d, final %d-%d", "h", "a", "home_goals_final", "away_goals_final")),
        F.when(~F.col("last_minute").between(30, 150), "implausible duration")))).alias("issue"))


# --------------------------------------------------------------------------- #
# Team evolution and context
# --------------------------------------------------------------------------- #
def team_matches(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Two rows per match, one per side, from that side's view."""
    m = matches.join(facts, "match_id")
    def side(team, gf, ga):
        return F.struct(F.col(team).alias("team"), F.lit(team.split("_")[0].upper()).alias("venue"),
                        F.col(gf).alias("goals_for"), F.col(ga).alias("goals_against"))
    return m.select("match_id", "competition", "match_date", "cards", F.explode(F.array(
        side("home_team", "home_goals", "away_goals"), side("away_team", "away_goals", "home_goals"))).alias("s")).select(
        "match_id", "competition", "match_date", "cards", "s.*")


def month_buckets(rows: DataFrame) -> DataFrame:
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return rows.groupBy("team", F.date_format("match_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("matches"), F.count_if(gf > ga).alias("wins"), F.count_if(gf == ga).alias("draws"),
        F.count_if(gf < ga).alias("losses"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"))


def evolution_verdict(months: DataFrame) -> DataFrame:
    """First against last third of a team's months (months are bounded per team)."""
    w = Window.partitionBy("team")
    r = months.withColumn("rn", F.row_number().over(w.orderBy("month"))).withColumn("n", F.count("*").over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    gd = F.col("goals_for") - F.col("goals_against")
    early, late = F.col("rn") <= third, F.col("rn") > F.col("n") - third
    per = r.groupBy("team").agg(
        ratio(F.sum(F.when(early, gd)), F.sum(F.when(early, F.col("matches")))).alias("early"),
        ratio(F.sum(F.when(late, gd)), F.sum(F.when(late, F.col("matches")))).alias("late"))
    delta = F.col("late") - F.col("early")
    return per.withColumn("verdict", F.when(delta > 0.3, "improved").when(delta < -0.3, "declined").otherwise("stable"))


def schedule_context(team_dates: DataFrame, window_days: int = 14) -> DataFrame:
    """Rest days and trailing match count per (league, team, date).

    Dates are reduced to counts per day first, so windows are bounded by the calendar.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    days = team_dates.groupBy("league", "team", "date").agg(F.count("*").alias("n")).withColumn("day", day)
    w = Window.partitionBy("league", "team").orderBy("day")
    return days.select(
        "league", "team", "date", (F.col("day") - F.max("day").over(w.rangeBetween(Window.unboundedPreceding, -1))).alias("rest_days"),
        F.coalesce(F.sum("n").over(w.rangeBetween(-window_days, -1)), F.lit(0)).alias("congestion"))


def competition_summary(matches: DataFrame, facts: DataFrame) -> DataFrame:
    j = matches.join(facts.select("match_id", "goals"), "match_id", "left")
    return j.groupBy("competition").agg(
        F.count("*").alias("matches"), F.avg(F.coalesce("goals", F.lit(0))).alias("goals_per_match"),
        F.avg("duration").alias("avg_minutes")).withColumn(
        "goals_per_90", ratio(F.col("goals_per_match") * 90.0, F.col("avg_minutes")))


def outcome_shares(rows: DataFrame, home: str, away: str, groups: list[str]) -> DataFrame:
    h, a = F.col(home), F.col(away)
    n = F.count("*")
    return rows.groupBy(*groups).agg(
        n.alias("n"), (F.count_if(h > a) / n).alias("home_win"), (F.count_if(h == a) / n).alias("draw"),
        (F.count_if(h < a) / n).alias("away_win"))


# --------------------------------------------------------------------------- #
# Vectors and the example metric
# --------------------------------------------------------------------------- #
def checkpoint_momentum(events: DataFrame, params: Params = Params(), headers: DataFrame | None = None) -> DataFrame:
    """Home momentum at the fixed checkpoints, one column each."""
    step = CHECKPOINTS[0]
    grid = game_grid(game_cells(events, step, (params.tau,), {}), step, (params.tau,), {}, F.lit(CHECKPOINTS[-1]), headers)
    mom = momentum(F.col("press_home_0"), F.col("press_away_0"))
    return grid.groupBy("match_id").agg(*[
        F.max(F.when(F.col("t") == t, mom)).alias(f"momentum_{t}") for t in CHECKPOINTS])


def match_vectors(events: DataFrame, params: Params = Params()) -> DataFrame:
    """22 dimensions per match: control, goal timing, volumes, drama."""
    c = F.col
    s = VECTOR_SCALES
    j = match_facts(events).join(checkpoint_momentum(events, params), "match_id")
    cap = lambda e: F.least(F.lit(1.0), e)
    dims = [c(f"momentum_{t}") for t in CHECKPOINTS]
    dims += [c(f"goals_{lo}_{hi}") / s["goals"] for lo, hi in GOAL_BINS]
    dims += [cap(c("shots") / s["shots"]), cap(c("corners") / s["corners"]), cap(c("cards") / s["cards"]), cap(c("goals") / (2 * s["goals"]))]
    dims += [cap(c("max_home_lead") / s["goals"]), cap(c("max_away_lead") / s["goals"]), cap(c("lead_changes") / 3.0),
             F.when(c("goals_from_85") > 0, 1.0).otherwise(0.0), cap(c("reds") / 2.0), F.abs(c(f"momentum_{CHECKPOINTS[-1]}") - 0.5) * 2]
    return j.select("match_id", F.array(*[d.cast("double") for d in dims]).alias("vec"))


def expected_chaos(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Example metric: how wild a match was, 0..1."""
    c = F.col
    j = match_facts(events).join(checkpoint_momentum(events, params), "match_id")
    swings = [F.abs(c(f"momentum_{b}") - c(f"momentum_{a}")) for a, b in zip(CHECKPOINTS, CHECKPOINTS[1:])]
    turbulence = sum(swings[1:], swings[0]) / len(swings)
    one = lambda e: F.least(e, F.lit(1.0))
    parts = [weight * one((turbulence if name == "turbulence" else c(name)) / full) for name, full, weight in CHAOS_WEIGHTS]
    value = F.least(F.lit(1.0), sum(parts[1:], parts[0]))
    out = j.select("match_id", value.alias("value"), "goals", "lead_changes", "goals_from_80", "reds")
    word = F.when(c("value") >= CHAOS_LEVELS[1], "wild").when(c("value") >= CHAOS_LEVELS[0], "lively").otherwise("calm")
    return out.select("match_id", F.lit("expected_chaos").alias("metric"), "value", F.format_string(
        "%s: %d goals, %d lead changes, %d late, %d red", word, "goals", "lead_changes", "goals_from_80", "reds").alias("summary"))


# --------------------------------------------------------------------------- #
# Story
# --------------------------------------------------------------------------- #
def transition_beats(states: DataFrame, goal_minutes: DataFrame | None = None, step: str = "minute") -> DataFrame:
    """Goal, regime shift or momentum handover between consecutive states of a match.

    ``detail`` is the score, the new regime with the side on top, or that side: codes, for
    which a caller keeps sentences of their own.
    """
    w = Window.partitionBy("match_id").orderBy(step)
    mom = F.col("momentum")
    s = states.select("*", *[F.lag(c).over(w).alias(f"was_{c}") for c in ("home_goals", "away_goals", "regime", "momentum")])
    s = s.where(F.col("was_regime").isNotNull())
    if goal_minutes is not None:
        echo = goal_minutes.select("match_id", F.col("minute").alias(step)).distinct().withColumn("echo", F.lit(True))
        s = s.join(echo, ["match_id", step], "left")
    else:
        s = s.withColumn("echo", F.lit(None).cast("boolean"))
    dh, da = F.col("home_goals") - F.col("was_home_goals"), F.col("away_goals") - F.col("was_away_goals")
    side = F.when(mom >= 0.5, "HOME").otherwise("AWAY")
    handover = ((F.col("was_momentum") - 0.5) * (mom - 0.5) < 0) & (F.abs(mom - 0.5) > SWING)
    shifted = (F.col("regime") != F.col("was_regime")) & F.col("echo").isNull()
    scored = (dh != 0) | (da != 0)
    score = F.concat(F.col("home_goals").cast("string"), F.lit("-"), F.col("away_goals").cast("string"))
    return s.select(
        "match_id", F.col(step).alias("minute"),
        F.when(scored, F.concat(F.lit("goal "), F.when(dh != 0, "HOME").otherwise("AWAY")))
        .when(shifted, "regime shift").when(handover, "momentum swing").alias("headline"),
        F.when(scored, score).when(shifted, F.concat_ws(" ", "regime", side)).when(handover, side).alias("detail"),
    ).where("headline IS NOT NULL")


def story(events: DataFrame, params: Params = Params(), step: int = 5) -> DataFrame:
    """Kick-off, transition beats and full time of every match."""
    states = panel(events, params, step=step, last=F.floor("last_event")).where(F.col("minute") >= step)
    goals = events.where("type = 'goal'").select("match_id", F.bround("minute", 0).cast("int").alias("minute"))
    beats = transition_beats(states, goals)
    ends = first_by(states.select("match_id", "minute", "home_goals", "away_goals"), ["match_id"], [F.col("minute")], largest=True)
    full = ends.select("match_id", "minute", F.lit("full time").alias("headline"),
                       F.concat(F.col("home_goals").cast("string"), F.lit("-"), F.col("away_goals").cast("string")).alias("detail"))
    start = ends.select("match_id", F.lit(0).alias("minute"), F.lit("kick-off").alias("headline"), F.lit("").alias("detail"))
    return start.unionByName(beats).unionByName(full)


# --------------------------------------------------------------------------- #
# Counterfactuals
# --------------------------------------------------------------------------- #
def find_events(events: DataFrame, requests: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Nearest event within tolerance for each request (match_id, at, type, team).

    The band join runs on clock slots of one tolerance, so a request only meets events of
    its own and the two neighbouring slots.
    """
    slot = F.floor(F.col("at") / tolerance)
    r = requests.select("match_id", "type", "team", "at", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    near = events.withColumn("slot", F.floor(F.col("minute") / tolerance)).join(r, ["match_id", "type", "team", "slot"]).where(F.abs(F.col("minute") - F.col("at")) <= tolerance)
    return first_by(near, ["match_id", "type", "team", "at"], [F.abs(F.col("minute") - F.col("at")), F.col("minute"), F.col("event_id")])


def what_if(events: DataFrame, requests: DataFrame, params: Params = Params()) -> DataFrame:
    """Baseline and counterfactual panels from the removed event to full time."""
    targets = find_events(events, requests).select("match_id", F.col("event_id").alias("removed"), F.floor("minute").alias("from_minute"))
    gone = targets.groupBy("match_id").agg(F.collect_set("removed").alias("gone"))
    ends = events.groupBy("match_id").agg(F.ceil(F.max("minute")).cast("int").alias("duration"))
    heads = ends.join(gone, "match_id", "left_semi").select(
        F.explode(F.array("match_id", F.concat("match_id", F.lit("#cf")))).alias("match_id"), "duration")
    # An event stands in both worlds, a removed one in the first only.
    both_ids = F.array(F.col("match_id"), F.concat("match_id", F.lit("#cf")))
    met = salted_join(events, gone, ["match_id"], ["event_id"])
    worlds = met.select(
        F.explode(F.when(F.array_contains("gone", F.col("event_id")), F.slice(both_ids, 1, 1)).otherwise(both_ids)).alias("match_id"), "minute", "team", "type")
    p = panel(worlds, params, headers=heads, last=F.col("duration"))
    p = p.select(F.regexp_replace("match_id", "#cf$", "").alias("match_id"), F.col("match_id").endswith("#cf").alias("cf"),
                 "minute", "goal_next_10min", "next_goal_home", "momentum", "home_goals", "away_goals")
    fields = ["goal_next_10min", "next_goal_home", "momentum", "home_goals", "away_goals"]
    both = p.groupBy("match_id", "minute").agg(*[
        F.max(F.when(F.col("cf") == flag, F.col(c))).alias(f"{name}_{c}") for flag, name in ((False, "base"), (True, "cf")) for c in fields])
    return both.join(targets, "match_id").where(F.col("minute") >= F.greatest(F.lit(1), F.col("from_minute")))


def what_if_summary(series: DataFrame) -> DataFrame:
    """Largest divergence and full-time scores of both worlds."""
    last = F.max_by(F.struct("base_home_goals", "base_away_goals", "cf_home_goals", "cf_away_goals",
                             (F.col("cf_next_goal_home") - F.col("base_next_goal_home")).alias("swing")), "minute")
    return series.groupBy("match_id", "removed").agg(
        F.max(F.abs(F.col("base_goal_next_10min") - F.col("cf_goal_next_10min"))).alias("max_divergence"), last.alias("l")).select(
        "match_id", "removed", "max_divergence", "l.*")


# --------------------------------------------------------------------------- #
# Lists
# --------------------------------------------------------------------------- #
def search_teams(matches: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Case-insensitive literal substring on either team, newest first."""
    q = F.lit(text.lower())
    hit = F.contains(F.lower("home_team"), q) | F.contains(F.lower("away_team"), q)
    return matches.where(hit).orderBy(F.col("match_date").desc_nulls_last(), "match_id").limit(limit)


def catalog(matches: DataFrame, competition: str | None = None) -> DataFrame:
    rows = matches if competition is None else matches.where(F.col("competition") == competition)
    return rows.orderBy("match_date", "match_id")


def match_detail(matches: DataFrame, facts: DataFrame, digests: DataFrame) -> DataFrame:
    """Header, volume, duration and content digest; goals are rows of ``goal_sequence``."""
    return matches.join(facts.select("match_id", "n_events", "last_minute", "goals"), "match_id", "left").join(
        digests.select("match_id", "digest"), "match_id", "left")


def named_events(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events with their players' names; a player's events are spread, however many they are."""
    return salted_join(events, names.select("player_id", "name"), ["player_id"], ["match_id", "minute"], "left")


def real_duration(events: DataFrame, stream: DataFrame | None = None) -> DataFrame:
    """Minutes actually covered: dense stream first, else last event, else 90."""
    base = events.groupBy("match_id").agg(F.max("minute").alias("last_event"))
    if stream is None:
        return base.select("match_id", F.coalesce("last_event", F.lit(90.0)).alias("minutes"))
    dense = stream.groupBy("match_id").agg((F.max("t") / 60.0).alias("stream_end"))
    return base.join(dense, "match_id", "full").select("match_id", F.coalesce("stream_end", "last_event", F.lit(90.0)).alias("minutes"))


def remember(timeline: DataFrame, entries: DataFrame) -> DataFrame:
    return timeline.unionByName(entries)


def replay(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("match_id", "minute", "event_id")


# --------------------------------------------------------------------------- #
# Metric registry
# --------------------------------------------------------------------------- #
class MetricRegistry:
    """Named metrics ``fn(events, params) -> DataFrame(match_id, metric, value, summary)``."""

    def __init__(self) -> None:
        self._metrics: dict = {}

    def register(self, name: str):
        def wrap(fn):
            self._metrics[name] = fn
            return fn
        return wrap

    def register_python(self, name: str, init, step, merge, finish):
        """A plain Python metric that is folded over each match, whatever its size.

        ``init()`` makes a state, ``step(state, pandas rows)`` adds rows of one match in no
        given order, ``merge(state, state)`` joins two states and ``finish(state)`` returns
        (value, summary). Every task folds its own rows first, so one match is spread over
        all tasks that hold rows of it and only states meet. A failing match becomes an
        error row.
        """
        def metric(events: DataFrame, params: Params) -> DataFrame:
            def fold(batches):
                held: dict = {}
                for pdf in batches:
                    for match_id, rows in pdf.groupby("match_id", sort=False, dropna=False):
                        state = held.get(match_id)
                        if isinstance(state, str):
                            continue
                        try:
                            held[match_id] = step(init() if state is None else state, rows)
                        except Exception as exc:
                            held[match_id] = f"error: {exc}"
                    if len(held) > 10_000:      # states move on, they are merged again later
                        yield packed(held)
                        held = {}
                if held:
                    yield packed(held)

            def packed(held):
                return pd.DataFrame({"match_id": list(held), "state": [pickle.dumps(s) for s in held.values()]}, dtype=object)

            def closed(match_id, state):
                try:
                    value, summary = (None, state) if failed(state) else finish(state)
                except Exception as exc:
                    value, summary = None, f"error: {exc}"
                return match_id, name, value, summary

            def failed(state):
                return isinstance(state, str) and state.startswith("error: ")

            def joined(a, b):
                if failed(a) or failed(b):
                    return a if failed(a) else b
                try:
                    return merge(a, b)
                except Exception as exc:
                    return f"error: {exc}"

            def close(batches):     # the states of a match stand together
                columns, key, state, begun = ["match_id", "metric", "value", "summary"], None, None, False
                for pdf in batches:
                    out = []
                    for match_id, packed_state in zip(pdf["match_id"], pdf["state"]):
                        one = pickle.loads(packed_state)
                        if begun and match_id == key:
                            state = joined(state, one)
                            continue
                        if begun:
                            out.append(closed(key, state))
                        key, state, begun = match_id, one, True
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                if begun:
                    yield pd.DataFrame([closed(key, state)], columns=columns, dtype=object)
            # a match's rows stand together in a task, so it is stepped over few times and its state moves once
            states = events.sortWithinPartitions("match_id").mapInPandas(fold, "match_id string, state binary")
            return states.repartition("match_id").sortWithinPartitions("match_id").mapInPandas(
                close, "match_id string, metric string, value double, summary string")
        self._metrics[name] = metric

    def run(self, events: DataFrame, params: Params = Params()) -> DataFrame:
        """All metrics in one DataFrame; one that cannot be planned becomes an error row."""
        out = []
        for name, fn in sorted(self._metrics.items()):
            try:
                out.append(fn(events, params).select("match_id", F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), "summary"))
            except Exception as exc:
                out.append(events.sparkSession.createDataFrame(
                    [(None, name, None, f"error: {type(exc).__name__}")], "match_id string, metric string, value double, summary string"))
        return reduce(DataFrame.unionByName, out)
