"""Versioned knowledge: ids, timelines, as-of reads, integrity, graph, sharing policy.

A knowledge table has: id, kind, layer, value, source, collected_at, parent,
pipeline_version, valid_from, valid_to, permanence, confidence, seq (arrival order) and
the context columns competition, season, match_id, team, player_id, minute.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.text import content_id
from pitchgrid.operators.ordered import first_by, neighbour, running_sums
from pitchgrid.settings import FACTUAL_LAYERS, INFERRED_LAYERS, PRIOR_LAYERS

ALWAYS = "0001-01-01"
KEY = ["kind", "entity"]


def entity(player: Column, team: Column, match: Column) -> Column:
    return F.coalesce(player, team, match)


def with_entity(records: DataFrame) -> DataFrame:
    return records.withColumn("entity", entity(F.col("player_id"), F.col("team"), F.col("match_id")))


def with_ids(records: DataFrame, context: list[str]) -> DataFrame:
    """Content id of the version and id of what it is about; both deterministic."""
    about = ["layer", "kind", *context, "source"]
    return records.withColumn("logical_id", content_id(*[F.col(c) for c in about])).withColumn(
        "record_id", content_id(*[F.col(c) for c in (*about, "value", "collected_at")]))


# --------------------------------------------------------------------------- #
# Timelines
# --------------------------------------------------------------------------- #
def build_timeline(versions: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Close each live permanent version with the next permanent one in arrival order.

    Rows that arrive closed keep their own end; temporary rows close nothing. A successor
    that is valid since always closes its predecessor from the beginning of time.
    """
    permanent = versions.where("permanence = 'permanent'")
    nxt = neighbour(permanent, KEY, F.floor(F.col("seq") / bucket_rows), ["seq"],
                    {"next_id": "id", "next_from": "valid_from"}, following=True)
    closes = F.col("valid_to").isNull() & F.col("next_id").isNotNull()
    closed = nxt.select(
        *[c for c in versions.columns if c != "valid_to"],
        F.when(closes, F.coalesce("next_from", F.lit(ALWAYS).cast("date"))).otherwise(F.col("valid_to")).alias("valid_to"),
        F.when(closes, F.col("next_id")).alias("superseded_by"))
    rest = versions.where("permanence <> 'permanent'").withColumn("superseded_by", F.lit(None).cast("string"))
    return closed.unionByName(rest)


def rank_columns() -> list[Column]:
    """Precedence of versions active on one date: largest wins."""
    return [
        (F.col("permanence") == "temporary").cast("int"), F.coalesce("valid_from", F.lit(ALWAYS).cast("date")),
        F.coalesce("confidence", F.lit(-1.0)), F.col("id"),
    ]


def active_at(at: Column) -> Column:
    """Half-open validity window; null means unbounded."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (
        F.col("valid_to").isNull() | (at < F.col("valid_to")))


def _with_dates(rows: DataFrame, dates: list[datetime.date]) -> DataFrame:
    """``rows`` with the caller's cut-off dates, each once, in ``__dates``."""
    one = rows.sparkSession.createDataFrame([(sorted(set(dates)),)], "__dates array<date>")
    return rows.crossJoin(F.broadcast(one))


def state_as_of(timeline: DataFrame, dates: list[datetime.date], keys: list[str] = KEY) -> DataFrame:
    """Winning version of every (kind, entity) at each date.

    The caller's dates travel as one broadcast row, however many there are: a version is
    repeated only for the dates it covers and the winner is a map-side-combined max_by.
    """
    rows = _with_dates(timeline, dates).withColumn("at", F.explode(F.filter("__dates", lambda at: active_at(at)))).drop("__dates")
    return first_by(rows, [*keys, "at"], rank_columns(), largest=True)


def history(timeline: DataFrame) -> DataFrame:
    """Every version, oldest validity first, in one distributed sort."""
    return timeline.orderBy(*KEY, F.coalesce("valid_from", F.lit(ALWAYS).cast("date")), "id")


def current_state(timeline: DataFrame) -> DataFrame:
    """Latest live permanent version per (kind, entity)."""
    live = timeline.where("permanence = 'permanent' AND valid_to IS NULL AND superseded_by IS NULL")
    return first_by(live, KEY, [F.coalesce("valid_from", F.lit(ALWAYS).cast("date")), F.col("id")], largest=True)


def future_leaks(records: DataFrame, as_of: Column) -> DataFrame:
    """Rows a state at ``as_of`` must not contain, with the reason."""
    reason = (
        F.when(F.col("valid_from") > as_of, "valid later")
        .when(F.col("collected_at") > as_of, "collected later")
        .when(~F.col("layer").isin(*PRIOR_LAYERS), "layer not allowed"))
    return records.withColumn("reason", reason).where("reason IS NOT NULL")


def assemble_state(timeline: DataFrame, dates: list[datetime.date]) -> DataFrame:
    """Pre-match knowledge: only prior layers, only what was collected by the date."""
    prior = timeline.where(F.col("layer").isin(*PRIOR_LAYERS))
    known = F.filter("__dates", lambda at: active_at(at) & (F.col("collected_at").isNull() | (F.col("collected_at") <= at)))
    rows = _with_dates(prior, dates).withColumn("at", F.explode(known)).drop("__dates")
    return first_by(rows, [*KEY, "at"], rank_columns(), largest=True)


def gate(simulated: DataFrame, audited: bool) -> DataFrame:
    """Admit model output only when audited; stamps the admission into provenance."""
    if not audited:
        raise PermissionError("simulated records need an audit before they are admitted")
    layer = F.when(F.col("layer") == "simulated", F.col("layer")).otherwise(
        F.raise_error(F.concat(F.lit("not a simulated record: "), "id")))
    return simulated.withColumn("layer", layer).withColumn(
        "transformations", F.concat(F.coalesce("transformations", F.array().cast("array<string>")), F.array(F.lit("audit:passed"))))


def store(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent write: the newest load of an id replaces its row, new ids are added."""
    cols = existing.columns
    both = existing.withColumn("__load", F.lit(0)).unionByName(incoming.select(*cols).withColumn("__load", F.lit(1)))
    rest = [c for c in cols if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), "__load").alias("r")).select("id", "r.*")


def enrich(records: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fill empty context fields; keep filled ones and flag contradictions."""
    e = extra.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = records.join(e, key, "left")
    clash = [F.when(F.col(f) != F.col(f"__{f}"), F.lit(f)) for f in fields]
    out = out.withColumn("conflicts", F.array_compact(F.array(*clash)))
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, f"__{f}"))
    return out.drop(*[f"__{f}" for f in fields])


def with_transformation(transformations: Column, parents: Column, name: str, new_parents: Column) -> tuple[Column, Column]:
    """Append a step and any parent not already cited."""
    none = F.array().cast("array<string>")
    return (F.concat(F.coalesce(transformations, none), F.array(F.lit(name))),
            F.array_union(F.coalesce(parents, none), F.coalesce(new_parents, none)))


def flatten(records: DataFrame, context: list[str]) -> DataFrame:
    """JSON view of a record; absent context fields are left out."""
    return records.select("id", F.to_json(F.struct(*context)).alias("context"))


# --------------------------------------------------------------------------- #
# Integrity
# --------------------------------------------------------------------------- #
def _violations(rows: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.alias("key"), detail.alias("detail"))


def _two_values(rows: DataFrame, rule: str, keys: list[str], value: Column) -> DataFrame:
    """Groups holding more than one distinct value, found with min / max only."""
    spread = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi")
    return _violations(spread, rule, F.concat_ws("/", *keys), F.concat_ws(" & ", "lo", "hi"))


def record_violations(records: DataFrame) -> DataFrame:
    """Rules that concern one record at a time."""
    inferred = F.col("layer").isin(*INFERRED_LAYERS)
    return records.select("id", F.explode(F.array_compact(F.array(
        F.when(F.coalesce(F.col("source"), F.lit("")) == "", "no provenance"),
        F.when(inferred & F.col("parent").isNull() & F.col("pipeline_version").isNull(), "no evidence"),
        F.when(F.col("minute").isNotNull() & F.col("match_id").isNull(), "event without match"),
    ))).alias("rule")).select("rule", F.col("id").alias("key"), F.lit("").alias("detail"))


def integrity(records: DataFrame, players: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """All always-on rules as one violations table (rule, key, detail)."""
    named = records.where("player_id IS NOT NULL AND team IS NOT NULL AND match_id IS NOT NULL")
    out = record_violations(records).unionByName(
        _two_values(named, "player on two teams", ["match_id", "player_id"], F.col("team")))
    if players is not None:
        lost = records.where("player_id IS NOT NULL").join(players.select("player_id"), "player_id", "left_anti")
        out = out.unionByName(_violations(lost, "unknown player", F.col("id"), F.col("player_id")))
    if matches is not None:
        lost = records.where("match_id IS NOT NULL").join(matches.select("match_id"), "match_id", "left_anti")
        out = out.unionByName(_violations(lost, "unknown match", F.col("id"), F.col("match_id")))
    return out


def isolation(records: DataFrame, group: list[str]) -> DataFrame:
    """Opt-in isolation of collections: one match, one season, one layer, no fact-inference mix."""
    season = F.concat_ws("/", F.coalesce("competition", F.lit("?")), F.coalesce("season", F.lit("?")))
    side = F.when(F.col("layer").isin(*FACTUAL_LAYERS), "fact").otherwise("inference")
    rules = {"several matches": F.col("match_id"), "several seasons": season,
             "several layers": F.col("layer"), "facts mixed with inference": side}
    stats = records.groupBy(*group).agg(*[
        f(v).alias(f"{n}{i}") for i, v in enumerate(rules.values()) for n, f in (("lo", F.min), ("hi", F.max))])
    found = F.array_compact(F.array(*[
        F.when(F.col(f"lo{i}") != F.col(f"hi{i}"), F.lit(r)) for i, r in enumerate(rules)]))
    return stats.select(*group, F.explode(found).alias("rule"))


def aggregate_mismatch(aggregates: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Stored counts that disagree with the events they summarise."""
    counted = events.groupBy(*keys).agg(F.count("*").alias("observed"))
    return aggregates.join(counted, keys, "left").withColumn(
        "observed", F.coalesce("observed", F.lit(0))).where(
        F.expr("try_cast(expected AS double) IS NULL") | (F.expr("try_cast(expected AS double)").cast("bigint") != F.col("observed")))


def chronology(events: DataFrame, keys: list[str], bucket_rows: int = 100_000) -> DataFrame:
    """Events whose minute runs backwards against everything before them in given order."""
    src = events.where("minute IS NOT NULL").withColumn("__b", F.floor(F.col("seq") / bucket_rows))
    from pyspark.sql import Window
    tops = src.groupBy(*keys, "__b").agg(F.max("minute").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__b", F.max("__m").over(before).alias("__top"))
    inside = Window.partitionBy(*keys, "__b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    joined = src.join(tops, [*keys, "__b"])
    return joined.withColumn("latest", F.greatest("__top", F.max("minute").over(inside))).where(
        F.col("minute") < F.col("latest")).drop("__b", "__top")


def enforce(violations: DataFrame) -> None:
    """Fail the job when a violations table is not empty."""
    first = violations.take(1)
    if first:
        raise ValueError(f"integrity violated: {first[0].asDict()}")


def audit(records: DataFrame) -> DataFrame:
    """Store summary: records and distinct matches per layer."""
    return records.groupBy("layer").agg(F.count("*").alias("records"), F.count_distinct("match_id").alias("matches"))


# --------------------------------------------------------------------------- #
# Graph
# --------------------------------------------------------------------------- #
def graph_edges(records: DataFrame) -> DataFrame:
    """Typed edges from record context, aggregated over the records behind them."""
    def node(kind, col):
        return F.concat(F.lit(kind + ":"), F.col(col))
    p, t, m, c = node("player", "player_id"), node("team", "team"), node("match", "match_id"), node("competition", "competition")
    pairs = [(p, "appeared_in", m), (p, "played_for", t), (t, "competed_in", m), (m, "part_of", c), (p, "active_in", c)]
    if {"home", "away"} <= set(records.columns):
        pairs.append((node("team", "home"), "faced", node("team", "away")))
    made = F.array_compact(F.array(*[
        F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("src"), F.lit(r).alias("relation"), b.alias("dst")))
        for a, r, b in pairs]))
    rows = records.select(F.explode(made).alias("e"), "source", "valid_from", "valid_to")
    return rows.groupBy("e.src", "e.relation", "e.dst").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.when(F.count("*") == F.count("valid_from"), F.min("valid_from")).alias("valid_from"),
        F.when(F.count("*") == F.count("valid_to"), F.max("valid_to")).alias("valid_to"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().select(
        "key", F.substring_index("key", ":", 1).alias("type"))


def neighbours(edges: DataFrame, node: str, relation: str | None = None, at: Column | None = None) -> DataFrame:
    """Nodes next to ``node``: the strongest relation per neighbour."""
    touching = edges.where((F.col("src") == node) | (F.col("dst") == node))
    if relation is not None:
        touching = touching.where(F.col("relation") == relation)
    if at is not None:
        touching = touching.where(active_at(at))
    out = touching.select(
        F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node"),
        F.when(F.col("src") == node, "out").otherwise("in").alias("direction"), "relation", "n", "src", "dst")
    return first_by(out, ["node"], [-F.col("n"), F.col("src"), F.col("relation"), F.col("dst")]).drop("src", "dst")


def top_edges(edges: DataFrame, limit: int) -> DataFrame:
    return edges.orderBy(F.col("n").desc(), "src", "relation", "dst").limit(limit)


# --------------------------------------------------------------------------- #
# Sharing policy
# --------------------------------------------------------------------------- #
def classify_sharing(records: DataFrame, policy: dict | None) -> DataFrame:
    """Add ``sharing``: locked source, then kind, then layer, then default (deny).

    A policy that does not parse denies everything.
    """
    allowed = ("local_only", "syncable")
    try:
        policy = policy or {}
        kinds, layers = dict(policy.get("by_kind") or {}), dict(policy.get("by_layer") or {})
        default, locked = policy.get("default", "local_only"), list(policy.get("local_sources") or [])
        if any(v not in allowed for v in [*kinds.values(), *layers.values(), default]):
            raise ValueError("unknown sharing value")
    except (ValueError, TypeError, AttributeError):
        kinds, layers, default, locked = {}, {}, "local_only", []

    def rule(column, table):
        if not table:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), F.col(column))
    is_locked = F.coalesce(F.col("source").isin(*locked), F.lit(False)) if locked else F.lit(False)
    return records.withColumn("sharing", F.when(is_locked, "local_only").otherwise(
        F.coalesce(rule("kind", kinds), rule("layer", layers), F.lit(default))))


# --------------------------------------------------------------------------- #
# Lifting engine output into records
# --------------------------------------------------------------------------- #
def lift(df: DataFrame, values: list[str], kind_prefix: str, layer: str, pipeline: str, context: list[str],
         confidence: Column | None = None) -> DataFrame:
    """Unpivot value columns into one record per (context, kind)."""
    conf = confidence if confidence is not None else F.lit(None).cast("double")
    wide = df.select(*context, conf.alias("confidence"), *[F.col(v).cast("double").alias(v) for v in values])
    long = wide.unpivot([*context, "confidence"], values, "kind", "value")
    return long.select(
        *context, F.concat(F.lit(kind_prefix), "kind").alias("kind"), F.lit(layer).alias("layer"),
        "value", F.lit("engine").alias("source"), F.lit(pipeline).alias("pipeline_version"), "confidence")


#: Where a lifted record belongs; columns that an output lacks are null.
LIFT_CONTEXT = {"match_id": "string", "minute": "double", "team": "string", "player_id": "string", "competition": "string", "date": "date"}
#: Per kind: layer, source, pipeline and the type of its value.
LIFTED = {
    "pred_goal_next_5min": ("probabilistic", "engine", "prediction/poisson", "double"),
    "pred_goal_next_10min": ("probabilistic", "engine", "prediction/poisson", "double"),
    "pred_goal_before_half": ("probabilistic", "engine", "prediction/poisson", "double"),
    "pred_next_goal": ("probabilistic", "engine", "prediction/poisson", "struct<home:double,away:double>"),
    "sim_outcome": ("simulated", "simulation", "simulation/closed-form", "struct<home:double,draw:double,away:double>"),
    "sim_expected_goals": ("simulated", "simulation", "simulation/closed-form", "struct<home:double,away:double>"),
    "sim_goal_prob": ("simulated", "simulation", "simulation/closed-form", "struct<home:double,away:double,any:double>"),
    "player_profile": ("derived", "engine", "profiling/dna",
                       "struct<actions:bigint,pass_accuracy:double,progressive_pass_share:double,key_pass_rate:double,shot_share:double,turnover_rate:double,label:string>"),
    "match_vector": ("derived", "engine", "similarity/vector", "array<double>"),
    "behavioral_profile": ("derived", "engine", "behavior/indices",
                           "struct<decision_stability:double,pressure_resistance:double,aggression_control:double,resilience:double,reasons:map<string,string>>"),
    "team_context": ("observed", "calendar", "context/schedule", "struct<venue:string,rest_days:bigint,congestion:bigint>"),
    "competition_strength": ("derived", "engine", "context/competition_strength", "double"),
}


def lift_values(df: DataFrame, values: dict[str, Column], confidence: Column | None = None, source_version: str | None = None) -> DataFrame:
    """Per row of ``df`` a record of each kind in ``values``: the row's context columns, and the value as a VARIANT of the kind's type; null values give none.

    The id hashes kind, layer, source, context and value, so the same output lifted twice has the same ids. All kinds
    leave one pass over the rows.
    """
    own = {c.lower() for c in df.columns}
    context = [(F.col(c) if c in own else F.lit(None)).cast(t).alias(c) for c, t in LIFT_CONTEXT.items()]
    # JSON keeps a lone number, a list or an object alike inside one field.
    text = lambda kind, v: F.to_json(F.struct(v.cast(LIFTED[kind][3]).alias("v")), {"ignoreNullFields": "false"})
    told = [F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), *(F.lit(x).alias(n) for n, x in zip(("layer", "source", "pipeline_version"), LIFTED[kind])), text(kind, v).alias("text")))
            for kind, v in values.items()]
    conf = (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence")
    rows = df.select(*context, conf, F.explode(F.array_compact(F.array(*told))).alias("r")).select("r.*", *LIFT_CONTEXT, "confidence")
    key = content_id(*[F.col(c) for c in ("kind", "layer", "source", *LIFT_CONTEXT, "text")])
    return rows.withColumns({
        "source_version": F.lit(source_version).cast("string"), "id": key, "value": F.try_variant_get(F.parse_json("text"), "$.v", "variant")}).drop("text")


def typed_values(records: DataFrame, kind: str) -> DataFrame:
    """The records of one kind with ``value`` in that kind's own type."""
    return records.where(F.col("kind") == kind).withColumn("value", F.variant_get("value", "$", LIFTED[kind][3]))


def lift_outputs(
    *, panels: DataFrame | None = None, projections: DataFrame | None = None, profiles: DataFrame | None = None, vectors: DataFrame | None = None,
    behaviours: DataFrame | None = None, contexts: DataFrame | None = None, strengths: DataFrame | None = None, source_version: str | None = None,
) -> DataFrame:
    """The engine's outputs, as their plans give them, as records of one table; what is left out is not lifted.

    Panels become predictions, projections simulated records, profiles, vectors and behaviour derived ones; a team's match
    context is observed, a competition's strength derived. ``projections`` and ``panels`` are pinned to their minute.
    """
    out, conf = [], F.col("confidence")
    if panels is not None:
        told = {f"pred_{c}": F.col(c) for c in ("goal_next_5min", "goal_next_10min", "goal_before_half")}
        told["pred_next_goal"] = F.struct(F.col("next_goal_home").alias("home"), (1.0 - F.col("next_goal_home")).alias("away"))
        out.append(lift_values(panels, told, conf))
    if projections is not None:
        sides = {"sim_outcome": ("home_win", "draw", "away_win"), "sim_expected_goals": ("expected_home", "expected_away"), "sim_goal_prob": ("goal_home", "goal_away", "goal_any")}
        out.append(lift_values(projections, {kind: F.struct(*columns) for kind, columns in sides.items()}, source_version=source_version))
    if profiles is not None:
        shares = ("actions", "pass_accuracy", "progressive_pass_share", "key_pass_rate", "shot_share", "turnover_rate", "label")
        out.append(lift_values(profiles, {"player_profile": F.struct(*shares)}, conf))
    if vectors is not None:
        out.append(lift_values(vectors, {"match_vector": F.col("vec")}))
    if behaviours is not None:
        indices = ("decision_stability", "pressure_resistance", "aggression_control", "resilience", "reasons")
        out.append(lift_values(behaviours, {"behavioral_profile": F.struct(*indices)}, conf))
    if contexts is not None:
        out.append(lift_values(contexts, {"team_context": F.struct("venue", "rest_days", "congestion")}))
    if strengths is not None:
        out.append(lift_values(strengths, {"competition_strength": F.col("goals_per_match")}))
    return reduce(lambda a, b: a.unionByName(b), out)
