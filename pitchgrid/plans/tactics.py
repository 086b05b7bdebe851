"""Spatial readings: trailing geometry, thirds, counter-attacks, tactic labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.clock import lane, third
from pitchgrid.functions.scoring import ratio
from pitchgrid.operators.grid import game_cells, game_grid
from pitchgrid.operators.ordered import neighbour
from pitchgrid.plans.snapshots import momentum
from pitchgrid.settings import ATTACK_TYPES, LANES

COUNTER_MINUTES = 10.0 / 60.0


def geometry(events: DataFrame, *, tau: float = 10.0, window: int = 15, step: int = 5) -> DataFrame:
    """Block height, lane shares and territory over the trailing window, per grid minute.

    Cell sums are decayed to their cell and re-scaled when read, so the trailing frame adds
    bounded numbers; events exactly on a cell border are kept apart because the window
    includes its left end.
    """
    if window % step:
        raise ValueError("the trailing window must be a multiple of the grid step")
    local = {}
    for side in ("home", "away"):
        here = (F.col("team") == side.upper()) & F.col("x").isNotNull()
        w = F.exp((F.col("minute") - F.col("cell")) / tau)
        parts = {f"w_{side}": w, f"wx_{side}": w * F.col("x"), f"n_{side}": F.lit(1.0)}
        for n in LANES:
            parts[f"{n}_{side}"] = F.when(F.col("type").isin(*ATTACK_TYPES) & (lane(F.col("y")) == n), w).otherwise(0.0)
        for name, value in parts.items():
            local[name] = F.when(here, value).otherwise(0.0)
            local[f"edge_{name}"] = F.when(here & (F.col("minute") == F.col("cell")), value).otherwise(0.0)
    grid = game_grid(game_cells(events, step, (tau,), {}, None, local), step, (tau,), {}, None, None, None, local)
    along = Window.partitionBy("match_id").orderBy("t")
    inner, border = along.rangeBetween(-(window - step), 0), along.rangeBetween(-window, -window)
    def trailing(name, faded=True):
        scale = F.exp(F.col("t") / tau) if faded else F.lit(1.0)
        total = F.sum(F.col(f"__{name}") * scale).over(inner) + F.coalesce(F.sum(F.col(f"__edge_{name}") * scale).over(border), F.lit(0.0))
        return total / scale
    cols = [F.col("match_id"), F.col("t").alias("minute"), momentum(F.col("press_home_0"), F.col("press_away_0")).alias("territory_home")]
    for side in ("home", "away"):
        cols += [trailing(f"w_{side}").alias(f"w_{side}"), trailing(f"wx_{side}").alias(f"wx_{side}"),
                 trailing(f"n_{side}", False).cast("bigint").alias(f"actions_{side}")]
        cols += [trailing(f"{n}_{side}").alias(f"{n}_{side}") for n in LANES]
    raw = grid.select(*cols)
    out = ["match_id", "minute", "territory_home"]
    for side in ("home", "away"):
        total = sum((F.col(f"{n}_{side}") for n in LANES[1:]), F.col(f"{LANES[0]}_{side}"))
        out += [f"actions_{side}",
                F.when(F.col(f"actions_{side}") > 0, F.try_divide(F.col(f"wx_{side}"), F.col(f"w_{side}"))).otherwise(50.0).alias(f"block_{side}")]
        out += [F.when(total > 1e-12, F.col(f"{n}_{side}") / total).otherwise(1.0 / 3).alias(f"share_{n}_{side}") for n in LANES]
    shaped = raw.select(*out)
    attacker = F.when(F.col("territory_home") >= 0.5, "HOME").otherwise("AWAY")
    def share(n):
        return F.when(attacker == "HOME", F.col(f"share_{n}_home")).otherwise(F.col(f"share_{n}_away"))
    top = F.greatest(*[share(n) for n in LANES])
    name = F.coalesce(*[F.when(F.abs(share(n) - top) < 1e-9, n) for n in LANES])
    return shaped.withColumn("top_team", attacker).withColumn("top_lane", name).withColumn("top_share", top)


def thirds(events: DataFrame) -> DataFrame:
    """Share of each side's located events per pitch third."""
    t = third(F.col("x"))
    counts = events.groupBy("match_id", "team").agg(
        F.count("x").alias("located"), *[F.count_if(t == n).alias(n) for n in ("own", "mid", "att")])
    return counts.select("match_id", "team", *[ratio(F.col(n), F.col("located")).alias(n) for n in ("own", "mid", "att")])


def counters(events: DataFrame) -> DataFrame:
    """Own third to attacking third within ten seconds, consecutive located events of a side."""
    located = events.where("x IS NOT NULL").select("match_id", "team", "event_id", "minute", "x")
    nxt = neighbour(located, ["match_id", "team"], F.floor(F.col("minute") * 6), ["minute", "event_id"],
                    {"next_minute": "minute", "next_x": "x"}, following=True)
    return nxt.where((F.col("x") < 100.0 / 3) & (F.col("next_x") > 200.0 / 3) & (F.col("next_minute") - F.col("minute") <= COUNTER_MINUTES))


def tactic_labels(events: DataFrame) -> DataFrame:
    fast = counters(events).groupBy("match_id", "team").agg(F.count("*").alias("counters"))
    j = thirds(events).join(fast, ["match_id", "team"], "left").fillna(0, ["counters"])
    return j.withColumn("tactic", F.when(F.col("counters") > 0, "counter_attack").when(F.col("own") > 0.5, "low_block").when(
        F.col("att") > 0.5, "high_press").otherwise("mid_block"))
