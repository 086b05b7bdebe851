"""Reconciling several providers' records into one, with provenance."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.text import apply_aliases, content_id, entity_key, prefixed_id
from pitchgrid.operators.skew import salted_join
from pitchgrid.settings import FUSED_FIELDS

FIXTURE = ["date", "home_key", "away_key"]


def resolve(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add canonical fixture keys; a provider's later duplicate replaces the earlier one.

    ``records`` needs source, seq (ingest order), date, home, away. The replacement is a
    map-side-combined max_by, not a window.
    """
    keyed = records.withColumn("home_key", entity_key(F.col("home"))).withColumn("away_key", entity_key(F.col("away")))
    keyed = apply_aliases(keyed, ["home_key", "away_key"], aliases)
    rest = [c for c in keyed.columns if c not in (*FIXTURE, "source")]
    return keyed.groupBy(*FIXTURE, "source").agg(
        F.max_by(F.struct(*rest), "seq").alias("r")).select(*FIXTURE, "source", "r.*")


def fixtures_seen(resolved: DataFrame) -> DataFrame:
    """Full outer view of all providers: one row per fixture with its sources."""
    return resolved.groupBy(*FIXTURE).agg(
        F.count("*").alias("n_sources"), F.array_sort(F.collect_set("source")).alias("sources"))


def with_prior(resolved: DataFrame, priors: dict[str, float] | DataFrame | None) -> DataFrame:
    """``resolved`` with each source's ``prior`` (1 where none is known), from a caller's dict or a table (source, rate)."""
    if priors is None or priors == {}:
        return resolved.withColumn("__prior", F.lit(1.0))
    if isinstance(priors, dict):
        priors = resolved.sparkSession.createDataFrame(sorted(priors.items()), "source string, rate double")
    table = priors.select(F.col("source").alias("__source"), F.col("rate").cast("double").alias("__prior"))
    joined = resolved.join(table, F.col("source") == F.col("__source"), "left").drop("__source")
    return joined.withColumn("__prior", F.coalesce("__prior", F.lit(1.0)))


VOTE = "struct<value:double,confidence:double,agreed:boolean,sources:array<string>,dissent:map<string,double>>"
NO_CLUSTERS = "array<struct<ref:double,weight:double,top:double,sources:array<string>,total:double>>"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def unanimous(claims: Column, tol: Column) -> Column:
    """All values within tolerance of each other: one cluster."""
    return F.array_max(claims.value) - F.array_min(claims.value) <= tol


def vote(claims: Column, tol: Column) -> Column:
    """The outcome (VOTE) of a cell's claims (source, value, prior), sorted by source.

    A fold places each claim into the first cluster within tolerance. The winner has the largest weight, then the largest
    single prior, then the last source list in order. Only cells in dispute are folded.
    """
    def place(acc, c):
        at = F.array_position(F.transform(acc, lambda k: F.abs(k.ref - c.value) <= tol), F.lit(True))
        grown = F.transform(acc, lambda k, i: F.when(i == at - 1, F.struct(
            k.ref.alias("ref"), (k.weight + c.prior).alias("weight"), F.greatest(k.top, c.prior).alias("top"),
            F.concat(k.sources, F.array(c.source)).alias("sources"), (k.total + c.value).alias("total"))).otherwise(k))
        fresh = F.array(F.struct(c.value.alias("ref"), c.prior.alias("weight"), c.prior.alias("top"),
                                 F.array(c.source).alias("sources"), c.value.alias("total")))
        return F.when(at > 0, grown).otherwise(F.concat(acc, fresh))

    def outcome(total, weight, weights, agreed, sources, dissent):
        return F.struct((total / F.size(sources)).alias("value"), F.coalesce(F.try_divide(weight, weights), F.lit(0.0)).alias("confidence"),
                        agreed.alias("agreed"), sources.alias("sources"),
                        F.map_from_arrays(F.transform(dissent, lambda c: c.source), F.transform(dissent, lambda c: c.value)).alias("dissent")).cast(VOTE)

    def won(clusters):
        best = F.array_max(F.transform(clusters, lambda k: F.struct(
            k.weight.alias("weight"), k.top.alias("top"), k.sources.alias("sources"), k.total.alias("total"))))
        weights = F.aggregate(clusters, F.lit(0.0), lambda acc, k: acc + k.weight)
        return _bind(best, lambda win: outcome(
            win.total, win.weight, weights, F.size(clusters) == 1, win.sources, F.filter(claims, lambda c: ~F.array_contains(win.sources, c.source))))

    none = F.from_json(F.lit('{"confidence": 0.0, "agreed": false, "sources": [], "dissent": {}}'), VOTE)
    nobody = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    single = _bind(_sum(claims.prior), lambda w: F.struct(
        (_sum(claims.value) / F.size(claims)).alias("value"), F.coalesce(F.try_divide(w, w), F.lit(0.0)).alias("confidence"), F.lit(True).alias("agreed"),
        claims.source.alias("sources"), nobody.alias("dissent")).cast(VOTE))
    folded = F.aggregate(claims, F.from_json(F.lit("[]"), NO_CLUSTERS), place)
    return F.when(F.size(claims) == 0, none).when(unanimous(claims, tol), single).otherwise(_bind(folded, won))


def claimed(resolved: DataFrame, tolerance: dict[str, float] | None, fields: tuple, priors: tuple[str, ...] = ("__prior",)) -> DataFrame:
    """One row per (fixture, field) with its claims (source, value, and a prior of each column in ``priors``) and tolerance.

    The records of a fixture (at most one per provider) meet in one shuffle of whole rows; fields are unpivoted after it.
    """
    row = F.struct(F.col("source"), *[F.col(p) for p in priors], *[F.col(f).cast("double").alias(f) for f in fields])
    met = resolved.groupBy(*FIXTURE).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    def claims(f):
        return F.transform(F.filter("rows", lambda r: r[f].isNotNull()), lambda r: F.struct(
            r.source.alias("source"), r[f].alias("value"), *[r[p].alias(p.strip("_")) for p in priors]))
    return met.select(*FIXTURE, F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), claims(f).alias("claims"),
        F.lit(float((tolerance or {}).get(f, 0.0))).alias("tol")) for f in fields])).alias("c")).select(*FIXTURE, "c.field", "c.claims", "c.tol")


def fuse(resolved: DataFrame, priors: dict[str, float] | DataFrame | None = None,
         tolerance: dict[str, float] | None = None, fields: tuple = FUSED_FIELDS) -> DataFrame:
    """Weighted :func:`vote` per (fixture, field)."""
    cells = claimed(with_prior(resolved, priors), tolerance, fields)
    return cells.withColumn("v", vote(F.col("claims"), F.col("tol"))).select(*FIXTURE, "field", "v.*", F.size("claims").alias("n_claims"))


def unified(cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per fixture: contributors, conflicting fields, number of fused fields."""
    conflicts = cells.groupBy(*FIXTURE).agg(
        F.array_sort(F.collect_list(F.when((F.col("n_claims") > 0) & ~F.col("agreed"), F.col("field")))).alias("conflicts"),
        F.count_if(F.col("n_claims") > 0).alias("n_fields"))
    return fixtures_seen(resolved).join(conflicts, FIXTURE)


def agreement(cells: DataFrame) -> DataFrame:
    """Per field over cells with at least two contributors: compared, agreed, rate."""
    out = cells.groupBy("field").agg(
        F.count_if(F.col("n_claims") >= 2).alias("compared"),
        F.count_if((F.col("n_claims") >= 2) & F.col("agreed")).alias("agreed"))
    return out.withColumn("rate", F.try_divide(F.col("agreed").cast("double"), F.col("compared")))


def measured_reliability(cells: DataFrame) -> DataFrame:
    """How often each source sided with the fused majority."""
    votes = cells.where("n_claims >= 2").select(F.explode(F.concat(
        F.transform("sources", lambda s: F.struct(s.alias("source"), F.lit(1).alias("hit"))),
        F.transform(F.map_keys("dissent"), lambda s: F.struct(s.alias("source"), F.lit(0).alias("hit"))))).alias("v"))
    return votes.groupBy("v.source").agg(
        F.sum("v.hit").alias("hits"), F.count("*").alias("total"),
        F.round(F.avg("v.hit"), 3).alias("rate"))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells whose fused value changes between two sets of priors."""
    a = before.select(*FIXTURE, "field", F.col("value").alias("before"))
    b = after.select(*FIXTURE, "field", F.col("value").alias("after"))
    return a.join(b, [*FIXTURE, "field"]).where(~F.col("before").eqNullSafe(F.col("after")))


def refuse_flips(resolved: DataFrame, priors: dict[str, float] | DataFrame | None, again: dict[str, float] | DataFrame | None,
                 tolerance: dict[str, float] | None = None, fields: tuple = FUSED_FIELDS) -> DataFrame:
    """The :func:`flips` between two fusions of the same records: both votes stand in one row, so cells are not joined,
    and only cells in dispute are voted on. Fixtures without a date or a key are left out, as there."""
    known = resolved.dropna(subset=FIXTURE)
    both = with_prior(with_prior(known, priors).withColumnRenamed("__prior", "__first"), again)
    cells = claimed(both, tolerance, fields, ("__first", "__prior")).where((F.size("claims") > 1) & ~unanimous(F.col("claims"), F.col("tol")))
    first = F.transform("claims", lambda c: F.struct(c.source.alias("source"), c.value.alias("value"), c["first"].alias("prior")))
    values = cells.select(*FIXTURE, "field", vote(first, F.col("tol")).value.alias("before"), vote(F.col("claims"), F.col("tol")).value.alias("after"))
    return values.where(~F.col("before").eqNullSafe(F.col("after")))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed replace with an ``action`` column: stored / updated / kept."""
    cols = incoming.columns
    both = stored.select(*cols, F.lit(0).alias("side")).unionByName(incoming.select(*cols, F.lit(1).alias("side")))
    rest = [c for c in cols if c not in keys]
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "side").alias("r"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    action = F.when(F.col("hi") == 0, "kept").when(F.col("lo") == 0, "updated").otherwise("stored")
    return merged.select(*keys, "r.*", action.alias("action"))


def canonical_match(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Normalised and resolved match records with provider-independent ids."""
    out = resolve(records, aliases)
    return out.withColumn("match_id", prefixed_id("match", F.concat_ws("|", F.col("date").cast("string"), "home_key", "away_key"))) \
        .withColumn("home_team_id", prefixed_id("team", F.col("home_key"))) \
        .withColumn("away_team_id", prefixed_id("team", F.col("away_key"))) \
        .withColumn("stage", F.lit("stage:canonical"))


def stage_of(transformations: Column) -> Column:
    """The pipeline stage of a record, from the first stage tag in its provenance."""
    tag = F.filter(transformations, lambda t: t.startswith("stage:"))
    name = F.substring_index(F.try_element_at(tag, F.lit(1)), ":", -1)
    return F.when(name.isin("raw", "normalized", "canonical"), name)


def lift_cells(cells: DataFrame, source: str = "fusion") -> DataFrame:
    """Fused cells as observed knowledge rows that keep their provenance."""
    value = F.to_json(F.struct("value", "confidence", "sources", "dissent", "agreed"))
    key = F.concat_ws("|", F.col("date").cast("string"), "home_key", "away_key")
    out = cells.where("n_claims > 0").select(
        F.col("field").alias("kind"), F.lit("observed").alias("layer"), prefixed_id("match", key).alias("match_id"),
        F.col("date"), F.col("home_key").alias("home"), F.col("away_key").alias("away"), F.lit(source).alias("source"),
        F.concat(F.lit("fuse:"), "field").alias("transformation"), value.alias("value"), "confidence")
    return out.withColumn("id", content_id(*[F.col(c) for c in ("kind", "layer", "match_id", "source", "value")]))


def fuse_preconditions(records: DataFrame, group: list[str], target: list[Column]) -> DataFrame:
    """Violations per intended fusion group; empty = safe to fuse."""
    factual = F.col("layer").isin("observed", "historical", "youth", "external")
    seen = F.concat_ws("|", *[F.coalesce(t.cast("string"), F.lit("~")) for t in target])
    stats = records.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("layer").alias("l0"), F.max("layer").alias("l1"),
        F.count_if(factual).alias("n_fact"), F.min(seen).alias("t0"), F.max(seen).alias("t1"),
        F.min("source").alias("s0"), F.max("source").alias("s1"))
    problem = (
        F.when(F.col("n") < 2, "fewer than two records")
        .when(F.col("l0") != F.col("l1"), "several layers")
        .when((F.col("n_fact") > 0) & (F.col("n_fact") < F.col("n")), "facts mixed with inference")
        .when(F.col("t0") != F.col("t1"), "different targets")
        .when(F.col("s0").eqNullSafe(F.col("s1")), "single source"))
    return stats.select(*group, problem.alias("problem")).where("problem is not null")


def consensus(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Heaviest claim per key; ties go to the smallest claim; zero weight gives null."""
    tally = readings.groupBy(*keys, "claim").agg(F.sum("weight").alias("w"))
    out = tally.groupBy(*keys).agg(
        F.min_by(F.struct("claim", "w"), F.struct(-F.col("w"), F.col("claim"))).alias("b"), F.sum("w").alias("total"))
    return out.select(*keys, F.when(F.col("total") != 0, F.col("b.claim")).alias("claim"),
                      F.coalesce(F.try_divide(F.col("b.w"), F.col("total")), F.lit(0.0)).alias("agreement"))


# --------------------------------------------------------------------------- #
# Clock alignment
# --------------------------------------------------------------------------- #
class Pairing:
    """Greedy pairing of one source's anchors with the reference's, along the clock.

    Each anchor, in order of its minute, takes the nearest free reference anchor (the earlier one of two as near) if it lies
    within ``window``. An anchor is decided as soon as the clock is past it by the window, so only what lies within a
    window of the clock is held, and every reading is put in and taken out once.
    """

    def __init__(self, window: float):
        self.window = window
        self.behind: deque[list] = deque()   # free reference readings up to the last decided anchor
        self.ahead: deque[list] = deque()    # and those after it; used ones leave from the left
        self.waiting: deque[tuple] = deque()

    def reference(self, minute: float, n: int) -> None:
        self.ahead.append([minute, n])

    def anchor(self, minute: float, n: int) -> None:
        self.waiting.append((minute, n))

    def decided(self, clock: float) -> Iterator[tuple[float, int]]:
        """(shift, number of pairs) of the anchors that nothing after ``clock`` can change."""
        while self.waiting and self.waiting[0][0] + self.window < clock:
            minute, todo = self.waiting.popleft()
            while self.ahead and self.ahead[0][0] <= minute:
                self.behind.append(self.ahead.popleft())
            while self.behind and minute - self.behind[0][0] > self.window:
                self.behind.popleft()
            while todo:
                back = minute - self.behind[-1][0] if self.behind else math.inf
                front = self.ahead[0][0] - minute if self.ahead else math.inf
                if min(back, front) > self.window:
                    break
                side, at = (self.behind, -1) if back <= front else (self.ahead, 0)
                near = side[at]
                take = min(todo, near[1])
                near[1] -= take
                todo -= take
                yield minute - near[0], take
                if not near[1]:
                    side.pop() if at else side.popleft()


def anchor_pairs(readings: DataFrame, sources: DataFrame, window: float) -> DataFrame:
    """match_id, source, shift, n: the greedy pairs of each source's readings (match_id, source, minute, n) with the first source's.

    ``sources`` has the sources of each match in order. Both sides meet in one pass over rows sorted by minute: the
    reference's readings stand beside those of each other source. A task holds what lies within a window of the clock, whatever a match has.
    """
    ref = F.col("source") == F.col("sources")[0]
    marked = readings.join(sources, "match_id").select(
        "match_id", F.explode(F.when(ref, F.slice("sources", 2, F.size("sources"))).otherwise(F.array("source"))).alias("source"), "minute", "n", F.when(ref, 0).otherwise(1).alias("side"))
    ordered = marked.repartition("match_id", "source").sortWithinPartitions("match_id", "source", "minute", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def flush(least: int):
            if len(out) > least:
                yield pa.RecordBatch.from_pylist([dict(zip(("match_id", "source", "shift", "n"), r)) for r in out], PAIRS)
                out.clear()

        for batch in batches:
            for match, source, minute, n, side in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (match, source) != key:
                    out += [(*key, *pair) for pair in state.decided(math.inf)] if state else []
                    key, state = (match, source), Pairing(window)
                out += [(*key, *pair) for pair in state.decided(minute)]
                (state.anchor if side else state.reference)(minute, n)
            yield from flush(10_000)
        if state:
            out += [(*key, *pair) for pair in state.decided(math.inf)]
        yield from flush(0)

    return ordered.mapInArrow(run, "match_id string, source string, shift double, n long")


PAIRS = pa.schema([("match_id", pa.string()), ("source", pa.string()), ("shift", pa.float64()), ("n", pa.int64())])


def weighted_median(values: DataFrame, keys: list[str], value: str, n: str, name: str, slot: Column) -> DataFrame:
    """Exact median of ``value`` with multiplicities per key.

    Counts of value slots tell the one or two slots that hold the middle; only their values are ordered. ``slot`` must not
    decrease with the value and have few settings.
    """
    counts = values.groupBy(*keys, value).agg(F.sum(n).alias("__n")).withColumn("__slot", slot)
    along = Window.partitionBy(*keys).orderBy("__slot")
    slots = counts.groupBy(*keys, "__slot").agg(F.sum("__n").alias("__s")).select(
        *keys, "__slot", "__s", F.sum("__s").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("__to"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__total"))
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    slots = slots.where((F.col("__to") > low) & (F.col("__to") - F.col("__s") <= high)).select(*keys, "__slot", (F.col("__to") - F.col("__s")).alias("__before"), "__total")
    inside = Window.partitionBy(*keys, "__slot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.join(slots, [*keys, "__slot"]).withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    middle = (F.min(F.when(F.col("__upto") > low, F.col(value))) + F.min(F.when(F.col("__upto") > high, F.col(value)))) / 2
    return upto.groupBy(*keys).agg(middle.alias(name))


def clock_offsets(events: DataFrame, anchor: str = "goal", window: float = 5.0) -> DataFrame:
    """Offset of every (match, source) clock against the first source by name: the median shift of its paired anchors, else 0.

    Anchors are reduced to distinct clock readings with a count before they are paired; a first source without anchors
    aligns nothing.
    """
    minute = F.when(F.col("type") == anchor, F.col("minute"))
    readings = events.groupBy("match_id", "source", minute.alias("minute")).agg(F.count("*").alias("n"))
    sources = readings.groupBy("match_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    pairs = anchor_pairs(readings.where("minute IS NOT NULL"), sources, window)
    median = weighted_median(pairs, ["match_id", "source"], "shift", "n", "median", F.floor(F.col("shift") * 16))
    every = sources.select("match_id", F.explode("sources").alias("source"))
    return every.join(median, ["match_id", "source"], "left").select(
        "match_id", "source", F.round(F.coalesce("median", F.lit(0.0)), 3).alias("offset"))


def align(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """All providers' events on the reference clock."""
    return salted_join(events, offsets, ["match_id", "source"], ["minute", "type"]).withColumn(
        "aligned_minute", F.round(F.col("minute") - F.col("offset"), 3))


def crosscheck(matches: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored final scores beside the fused ones (matches need date, home, away)."""
    keyed = matches.withColumn("home_key", entity_key(F.col("home"))).withColumn("away_key", entity_key(F.col("away")))
    goals = cells.where(F.col("field").isin("home_goals", "away_goals")).groupBy(*FIXTURE).agg(
        F.max(F.when(F.col("field") == "home_goals", F.col("value"))).alias("fused_home"),
        F.max(F.when(F.col("field") == "away_goals", F.col("value"))).alias("fused_away"))
    return keyed.join(goals, FIXTURE, "left").withColumn(
        "status", F.when(F.col("fused_home").isNull(), "unmatched").when(
            (F.col("fused_home") == F.col("home_goals")) & (F.col("fused_away") == F.col("away_goals")), "confirmed"
        ).otherwise("differs"))


def crosscheck_report(matches: DataFrame, cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """What independent providers say about each stored match (seq, date, home, away): the providers, the fields that
    several of them report, those on which all reports agree, the conflicts and the league. One provider without a
    fused fixture is reported as not verified.
    """
    keyed = matches.select("seq", "date", entity_key(F.col("home")).alias("home_key"), entity_key(F.col("away")).alias("away_key"))
    fields = cells.groupBy(*FIXTURE).agg(
        F.count_if(F.col("n_claims") >= 2).alias("fields_compared"), F.count_if((F.col("n_claims") > 0) & F.col("agreed")).alias("fields_agreed"),
        F.array_sort(F.collect_list(F.when((F.col("n_claims") > 0) & ~F.col("agreed"), F.col("field")))).alias("conflicts"))
    seen = resolved.groupBy(*FIXTURE).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("league").alias("league"))
    found = keyed.join(fields.join(seen, FIXTURE), FIXTURE, "left")
    return found.select(
        "seq", F.col("sources").isNotNull().alias("verified"), F.greatest(F.size(F.coalesce("sources", F.array())), F.lit(1)).alias("providers"),
        "sources", "fields_compared", "fields_agreed", "conflicts", "league")
