"""Position estimates from sparse observations (entity, t seconds, seq, x, y, name)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.ordered import carried, neighbour, running_sums
from pitchgrid.shared import cut
from pitchgrid.settings import CONF_HALF_LIFE, DRAG, MAX_GAP, MAX_SPEED

KEY = ["entity"]
ORDER = ["t", "seq"]


def _slot(seconds: int = 10):
    return F.floor(F.col("t") / seconds)


def velocities(observations: DataFrame) -> DataFrame:
    """Each observation with its predecessor and the capped velocity it implies.

    Two observations at one instant imply no velocity; the earlier one is carried on.
    """
    o = neighbour(observations, KEY, _slot(), ORDER, {"pt": "t", "px": "x", "py": "y"})
    dt = F.col("t") - F.col("pt")
    vx, vy = (F.col("x") - F.col("px")) / dt, (F.col("y") - F.col("py")) / dt
    speed = F.sqrt(vx * vx + vy * vy)
    scale = F.when(speed > MAX_SPEED, MAX_SPEED / speed).otherwise(1.0)
    first = F.col("pt").isNull()
    v = F.when(first, F.struct(F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))).when(
        dt > 0, F.struct((vx * scale).alias("vx"), (vy * scale).alias("vy")))
    return carried(cut(o.withColumn("v0", v)), KEY, _slot(), ORDER, "v0", "v").drop("v0")


def _travel(dt, drag: float):
    return (F.pow(F.lit(drag), dt) - 1.0) / math.log(drag) if 0 < drag < 1 else dt


def _on_pitch(c):
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def estimate(observations: DataFrame, at: list[float], *, drag: float = DRAG, half_life: float = CONF_HALF_LIFE,
             max_gap: float = MAX_GAP, use_velocity: bool = False) -> DataFrame:
    """Estimated position of every entity at each instant; stale entities are dropped."""
    v = velocities(observations)
    rows = v.withColumn("at", F.explode(F.filter(F.array(*[F.lit(float(a)) for a in at]), lambda a: a >= F.col("t"))))
    order = F.struct(*ORDER)
    last = rows.groupBy("entity", "at").agg(
        F.max_by(F.struct("t", "x", "y", "v"), order).alias("s"),
        F.max_by("name", F.when(F.col("name").isNotNull(), order)).alias("name"))
    age = F.col("at") - F.col("s.t")
    out = last.withColumn("age", age).where(F.col("age") <= max_gap)
    k = _travel(F.col("age"), drag)
    x, y = F.col("s.x"), F.col("s.y")
    keep = F.pow(F.lit(drag), F.col("age"))
    if use_velocity:
        x, y = _on_pitch(x + F.col("s.v.vx") * k), _on_pitch(y + F.col("s.v.vy") * k)
    vx, vy = (F.col("s.v.vx") * keep, F.col("s.v.vy") * keep) if use_velocity else (F.col("s.v.vx"), F.col("s.v.vy"))
    return out.select("entity", "at", "name", x.alias("x"), y.alias("y"), vx.alias("vx"), vy.alias("vy"),
                      F.when(F.col("age") <= 0, 1.0).otherwise(F.pow(F.lit(0.5), F.col("age") / half_life)).alias("confidence"),
                      "age", (F.col("age") < 0.05).alias("observed"))


def prediction_errors(observations: DataFrame, *, drag: float = DRAG, min_obs: int = 4) -> DataFrame:
    """Motion-model and stay-put error at every observation after an entity's first."""
    v = cut(velocities(observations))
    v = neighbour(v, KEY, _slot(), ORDER, {"pv": "v"})
    enough = observations.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= min_obs).select("entity")
    rows = v.where("pt IS NOT NULL").join(enough, "entity", "left_semi")
    dt = F.col("t") - F.col("pt")
    k = F.when(dt > 0, _travel(dt, drag)).otherwise(0.0)
    gx = F.when(dt > 0, _on_pitch(F.col("px") + F.col("pv.vx") * k)).otherwise(F.col("px"))
    gy = F.when(dt > 0, _on_pitch(F.col("py") + F.col("pv.vy") * k)).otherwise(F.col("py"))
    return rows.select("entity", "t", "seq", F.hypot(F.col("x") - gx, F.col("y") - gy).alias("error"),
                       F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("static_error"), dt.alias("gap"))


def evaluation(errors: DataFrame) -> DataFrame:
    """Mean, upper median and 90th of the errors beside the stay-put mean.

    Quantiles are exact: distinct error values are counted, the counts accumulated over
    fine error ranges, and the first value past each rank is taken.
    """
    errors = cut(errors)
    means = errors.agg(
        F.count("*").alias("n"), F.avg("error").alias("mean_error"), F.avg("static_error").alias("static_mean"),
        (F.avg("static_error") - F.avg("error")).alias("beats_static_by"), F.avg("gap").alias("mean_gap"))
    values = errors.groupBy("error").agg(F.count("*").alias("c"))
    upto = running_sums(values, [], F.floor(F.col("error") * 1000), [F.col("error")], {"upto": F.col("c")})
    past = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("error")))
    marks = upto.join(F.broadcast(means.select("n"))).agg(past(0.5).alias("median_error"), past(0.9).alias("p90_error"))
    return means.join(F.broadcast(marks))
