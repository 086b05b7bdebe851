"""Evaluation grid over match clocks.

Events are first reduced to one row per (match, clock cell): everything the model reads
at a grid minute decomposes over cells, also the exponentially decayed sums. The cells of
a match are bounded by its clock, not by its event count, so the windows that follow stay
small even if a third of all events belongs to one match, and the heavy shuffle carries
partial aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.settings import EVENT_WEIGHTS, SHOT_TYPES, TICK


def cell_of(minute: Column, step: int) -> Column:
    """Smallest grid minute that is not before ``minute``."""
    cell = F.ceil(minute / step) * step
    return F.when(cell < minute, cell + step).otherwise(cell).cast("int")


def event_weight(kind: Column) -> Column:
    expr = F.when(F.lit(False), 0.0)
    for name, weight in EVENT_WEIGHTS.items():
        expr = expr.when(kind == name, weight)
    return expr.otherwise(0.0)


def cell_aggregates(step: int, taus: tuple, targets: dict, decayed: dict | None = None,
                    local: dict | None = None) -> list[Column]:
    """Aggregates of one cell; usable in batch and in a streaming groupBy alike.

    ``decayed`` maps name -> (value, tau) for further decayed sums over the whole past,
    ``local`` maps name -> value for plain sums that stay with their cell.
    """
    m, kind, side = F.col("minute"), F.col("type"), F.col("team")
    cell = F.col("cell")
    home = side == "HOME"
    aggs = [
        F.count_if(~kind.eqNullSafe(F.lit(TICK))).alias("n_events"),
        F.max(m).alias("last_minute"),
        F.count_if((kind == "goal") & home).alias("home_goals"),
        F.count_if((kind == "goal") & (side == "AWAY")).alias("away_goals"),
        F.count_if((kind == "red_card") & home).alias("reds_home"),
        F.count_if((kind == "red_card") & (side == "AWAY")).alias("reds_away"),
        F.max(F.when(kind == "goal", m)).alias("last_goal"),
        F.max(F.when(kind == "red_card", m)).alias("last_red"),
        F.count_if(kind.isin(*SHOT_TYPES)).alias("shots"),
        F.count_if(kind.isin(*SHOT_TYPES) & (m == cell)).alias("edge_shots"),
    ]
    w = event_weight(kind)
    for i, tau in enumerate(taus):
        faded = w * F.exp((m - cell) / tau)
        aggs.append(F.sum(F.when(home, faded).otherwise(0.0)).alias(f"press_home_{i}"))
        aggs.append(F.sum(F.when(side == "AWAY", faded).otherwise(0.0)).alias(f"press_away_{i}"))
    for name, types in targets.items():
        aggs.append(F.min(F.when(kind.isin(*types), m)).alias(f"first_{name}"))
    for name, (value, tau) in (decayed or {}).items():
        aggs.append(F.coalesce(F.sum(value * F.exp((m - cell) / tau)), F.lit(0.0)).alias(name))
    for name, value in (local or {}).items():
        aggs.append(F.coalesce(F.sum(value), F.lit(0)).alias(name))
    return aggs


def game_cells(events: DataFrame, step: int, taus: tuple, targets: dict, decayed: dict | None = None,
               local: dict | None = None) -> DataFrame:
    return (
        events.withColumn("cell", cell_of(F.col("minute"), step))
        .groupBy("match_id", "cell").agg(*cell_aggregates(step, taus, targets, decayed, local))
    )


def growth(cell: Column, tau: float) -> Column:
    """exp(cell / tau), refused where sums of it would leave the range of a double."""
    return F.when(cell / tau > 650, F.raise_error(F.lit(f"tau = {tau} is too short for the length of the clock")).cast("double")).otherwise(F.exp(cell / tau))


def game_grid(
    cells: DataFrame, step: int, taus: tuple, targets: dict, last: Column | None = None,
    headers: DataFrame | None = None, decayed: dict | None = None, local: dict | None = None,
) -> DataFrame:
    """One row per (match, grid minute t) with everything known at t.

    ``last`` is an expression over ``duration`` and ``last_event`` for the final grid
    minute. Without ``headers(match_id, duration)`` the duration is floor(last minute)+1;
    with them, matches without events get a grid too.
    """
    sums = ["n_events", "home_goals", "away_goals", "reds_home", "reds_away"]
    here = ["shots", "edge_shots", *(local or {})]
    fading = {n: tau for n, (_, tau) in (decayed or {}).items()}
    for i, tau in enumerate(taus):
        fading.update({f"press_home_{i}": tau, f"press_away_{i}": tau})
    if headers is not None:
        cells = cells.unionByName(
            headers.select("match_id", F.lit(0).alias("cell"), "duration"), allowMissingColumns=True)
        cells = cells.groupBy("match_id", "cell").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
              for c in [*sums, *here, *fading]],
            *[F.max(c).alias(c) for c in ("last_minute", "last_goal", "last_red", "duration")],
            *[F.min(f"first_{n}").alias(f"first_{n}") for n in targets])
    match = Window.partitionBy("match_id")
    along = match.orderBy("cell")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    after = along.rowsBetween(1, Window.unboundedFollowing)

    cols = [F.col("match_id"), F.col("cell"), F.row_number().over(along).alias("__rn"),
            F.lead("cell").over(along).alias("__next"),
            F.max("last_minute").over(match).alias("last_event")]
    if headers is not None:
        cols.append(F.max("duration").over(match).alias("duration"))
    cols += [F.sum(c).over(upto).alias(c) for c in sums]
    cols += [F.max(c).over(upto).alias(c) for c in ("last_goal", "last_red")]
    cols += [F.col(c).alias(f"__{c}") for c in here]
    cols += [F.sum(F.col(c) * growth(F.col("cell"), tau)).over(upto).alias(c) for c, tau in fading.items()]
    for n in targets:
        cols.append(F.col(f"first_{n}").alias(f"__first_{n}"))
        cols.append(F.min(f"first_{n}").over(after).alias(f"next_{n}"))
    state = cells.select(*cols)
    if headers is None:
        state = state.withColumn("duration", F.floor("last_event").cast("int") + 1)
    end = F.ceil(F.coalesce("last_event", F.lit(90.0))).cast("int") if last is None else last
    state = state.withColumn("__end", end.cast("int"))
    state = (
        state.withColumn("__from", F.when(F.col("__rn") == 1, 0).otherwise(F.col("cell")))
        .withColumn("__to", F.least(F.coalesce(F.col("__next") - step, F.col("__end")), F.col("__end")))
        .where(F.col("__to") >= F.col("__from"))
        .withColumn("t", F.explode(F.expr(f"sequence(__from, __to, {step})")))
    )
    active = F.col("t") >= F.col("cell")
    out = [F.col("match_id"), F.col("t"), F.col("duration"), F.col("last_event")]
    out += [F.when(active, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in sums]
    out += [F.when(active, F.col(c)).alias(c) for c in ("last_goal", "last_red")]
    out += [F.when(F.col("t") == F.col("cell"), F.col(f"__{c}")).otherwise(0).alias(f"__{c}") for c in here]
    out += [F.when(active, F.col(c) * F.exp(-F.col("t") / tau)).otherwise(0.0).alias(c) for c, tau in fading.items()]
    for n in targets:
        out.append(F.when(active, F.col(f"next_{n}")).otherwise(
            F.least(f"__first_{n}", f"next_{n}")).alias(f"next_{n}"))
    return state.select(*out)


def with_recent_shots(grid: DataFrame, step: int, minutes: int) -> DataFrame:
    """Shots with t - minutes <= minute <= t, both ends included."""
    if minutes % step:
        raise ValueError("the trailing window must be a multiple of the grid step")
    along = Window.partitionBy("match_id").orderBy("t")
    recent = F.sum("__shots").over(along.rangeBetween(-(minutes - step), 0))
    edge = F.coalesce(F.sum("__edge_shots").over(along.rangeBetween(-minutes, -minutes)), F.lit(0))
    return grid.withColumn("recent_shots", (recent + edge).cast("bigint"))
