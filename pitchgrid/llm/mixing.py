"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions by a seeded order."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.llm.common import stored

#: Hex digits of the seeded order that one counting round looks at, and rounds: 12 bits each, 48 in all.
DIGITS, ROUNDS = 3, 4


def order_of(seed: str, doc_id: Column) -> Column:
    """The seeded place of a document in its source: 12 hex digits."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS * ROUNDS)


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Sources in code-point order, null last, with weights that repeat. ``sizes`` has a row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long"))


def water_fill(sources: DataFrame, total: Fraction, max_epochs: int = 2) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares of ``total`` by weight, clamped at
    ``max_epochs`` times the size; what a clamp frees goes to the others by weight until none is above its clamp.

    Each round is one aggregate over the table of sources; only two sums reach the driver. If all are clamped, the
    targets stay below ``total``. Sums are whole numbers and the target is one division, so reruns agree.
    """
    cap = F.col("source_size") * max_epochs
    state = sources.withColumn("clamped", F.lit(False))
    while True:
        sums = state.agg(
            F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("clamped"), cap)).alias("c")).first()
        if not sums.w:
            return state.withColumn("target", cap.cast("double")).drop("clamped")
        left = total - (sums.c or 0)
        above = ~F.col("clamped") & (F.col("weight").cast("decimal(38,0)") * left.numerator > cap.cast("decimal(38,0)") * (sums.w * left.denominator))
        if not state.filter(above).limit(1).count():
            share = (F.col("weight") * F.lit(left.numerator)).cast("double") / F.lit(float(sums.w * left.denominator))
            return state.withColumn("target", F.when(F.col("clamped"), cap.cast("double")).otherwise(share)).drop("clamped")
        state = state.withColumn("clamped", F.col("clamped") | above)


def mix_sources(docs: DataFrame, *, size: Column, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Documents with size, source_size, target and ``repeats`` (0 up to ``max_epochs``).

    Every document of a source is taken floor(target / size of the source) times; one more copy goes to those up to a
    threshold in the seeded order of the source, where the words taken come nearest to the target. The threshold is
    found like a quantile from exact sums: each round adds up the words per source and the next three hex digits, so a
    round's groups are at most 4096 a source and a source of any size is counted in parallel.

    Null sources are a source of their own; a null or empty text has size 0 and follows its order like the others;
    rows that repeat a doc_id stand together in the order. An empty table gives an empty table. Other columns stay,
    those of the added names (and whole, prefix, with_last, mix_source) are replaced or dropped.
    """
    rows = docs.withColumns({"size": F.coalesce(size, F.lit(0)).cast("long"), "mix_order": order_of(seed, F.col("doc_id"))}).drop(
        "source_size", "target", "repeats", "mix_source", "whole", "prefix", "with_last")
    lean = stored(rows.select("doc_id", "source", "size", "mix_order"), "mix-sizes")
    sizes = lean.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(source_weights(sizes, weights), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(sources, share * total, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("int"))
    goal = filled.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing"), F.lit("").alias("prefix"))
    for level in range(ROUNDS):
        cut = DIGITS * (level + 1)
        open_rows = lean.join(goal.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        open_rows = open_rows.filter(F.substring("mix_order", 1, DIGITS * level) == F.col("prefix"))
        counted = open_rows.groupBy("source", F.substring("mix_order", 1, cut).alias("digits")).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before", before).withColumnRenamed("source", "s")
        joined = goal.join(counted, F.col("source").eqNullSafe(F.col("s")) & (F.col("before") <= F.col("missing")), "left")
        # The group in which the words reach the goal; on the last level it is taken when that comes nearer.
        best = joined.groupBy("source", "source_size", "target", "whole", "missing").agg(F.max_by(F.struct("digits", "before", "words"), "digits").alias("at"))
        left = F.col("missing") - F.col("at.before")
        goal = stored(best.select(
            "source", "source_size", "target", "whole", left.alias("missing"), F.coalesce("at.digits", F.lit("")).alias("prefix"),
            F.coalesce(F.col("at.words") <= 2 * left, F.lit(False)).alias("with_last")), "mix-goal")
    goal = goal.select(F.col("source").alias("mix_source"), "source_size", "target", "whole", "prefix", "with_last")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    extra = (F.col("mix_order") < F.col("prefix")) | (F.col("with_last") & (F.col("mix_order") == F.col("prefix")))
    repeats = F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(max_epochs))
    return out.withColumn("repeats", repeats.cast("int")).drop("mix_order", "mix_source", "whole", "prefix", "with_last")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each repetition."""
    return mixed.filter("repeats > 0").select(*columns, F.explode(F.sequence(F.lit(1), "repeats")).alias("mix_copy")).drop("mix_copy")
