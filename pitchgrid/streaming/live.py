"""Live matches with Structured Streaming.

State is the same per-(match, cell) aggregate the batch plans use, so a streamed panel
equals the batch panel by construction, out-of-order events need no re-sorting, and a
match's state is bounded by its clock and released when the match ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.operators.grid import game_grid
from pitchgrid.operators.ordered import first_by, numbered
from pitchgrid.plans.snapshots import panel_from_grid
from pitchgrid.settings import TICK, Params
from pitchgrid.streaming.feed import OCCURRENCE, POLL_KEY, occurrences
from pitchgrid.streaming.keyed import CELL_NAMES, READING, added_cells, keyed_state, open_cells, readings


def read_files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """File stream over landed observations."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """File stream over a table, be it a folder of part files or a single file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return read_files(spark, path, schema)
    folder, _, name = path.rpartition("/")
    return read_files(spark, folder, schema, name)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything landed so far and stop; progress is kept in ``checkpoint``."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int, *by: str) -> None:
    """Idempotent sink: a retried batch replaces its own folder."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch_id}")


# --------------------------------------------------------------------------- #
# Cells and panels
# --------------------------------------------------------------------------- #
def follow_matches(spark: SparkSession, events: DataFrame, folder: str, params: Params = Params(), step: int = 1, **options) -> None:
    """Run the available events through the keyed state of their matches; readings go to the folder's log.

    ``options`` are those of :func:`pitchgrid.streaming.keyed.readings`. Open matches stay in the checkpoint's state store and the next
    run goes on with them.
    """
    log = f"{folder}/readings"
    write_batch(spark.createDataFrame([], READING), log, -1, "kind")
    with keyed_state(spark):
        run_available(readings(events, params, step=step, **options), lambda df, i: write_batch(df, log, i, "kind"), f"{folder}/checkpoint")


def logged(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Readings of one kind: ``panel``, ``late`` or, of released matches, ``cell``."""
    return spark.read.schema(READING + ", batch int").parquet(f"{folder}/readings").where(F.col("kind") == kind)


def current_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all matches: the log's of those released, the state store's of those that are open."""
    released = logged(spark, folder, "cell").select("match_id", "cell", *CELL_NAMES)
    with keyed_state(spark):
        return added_cells(released.unionByName(open_cells(spark, f"{folder}/checkpoint")))


def panels_from_cells(cells: DataFrame, params: Params = Params(), step: int = 1) -> DataFrame:
    """All panels up to each match's clock; heartbeats extend the clock."""
    grid = game_grid(cells, step, (params.tau,), {})
    return panel_from_grid(grid, params, step=step)


def current_panels(panels: DataFrame) -> DataFrame:
    return first_by(panels, ["match_id"], [F.col("minute")], largest=True)


def stream_panels(spark: SparkSession, events: DataFrame, folder: str, params: Params = Params(), step: int = 1, **options) -> DataFrame:
    """Run the available events through the stream and return the panels of its state and its log.

    Both survive restarts: rebuilding from the folder gives the same panels on any worker.
    """
    follow_matches(spark, events, folder, params, step, **options)
    return panels_from_cells(current_cells(spark, folder), params, step)


# --------------------------------------------------------------------------- #
# Polled feeds
# --------------------------------------------------------------------------- #
def feed_polls(spark: SparkSession, polls: DataFrame, folder: str) -> DataFrame:
    """Log new occurrences of polled observations, and players that become known; one row an occurrence comes back.

    What has been reported is keyed state (:class:`pitchgrid.streaming.feed.Occurrences`), so a batch costs what it brings.
    The log begins as an empty table; a retried batch replaces its own folder.
    """
    log = f"{folder}/observations"
    write_batch(spark.createDataFrame([], OCCURRENCE), log, -1)
    with keyed_state(spark):
        run_available(occurrences(polls), lambda df, i: write_batch(df, log, i), f"{folder}/checkpoint")
    entries = spark.read.schema(OCCURRENCE + ", batch int").parquet(log)
    return entries.groupBy(*POLL_KEY, "occurrence").agg(F.max_by("player_id", "batch").alias("player_id"))


def live_clock(events: DataFrame) -> DataFrame:
    """The clock never runs back: largest minute seen, ticks included."""
    return events.groupBy("match_id").agg(F.max("minute").alias("clock"))


def without_ticks(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") != TICK)


def split_late(batch: DataFrame, arrived: Column, newest: Column, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """On-time rows and rows older than the newest arrival minus the allowed delay."""
    late = F.unix_micros(arrived) < F.unix_micros(newest) - delay_seconds * 1_000_000
    return batch.where(~late), batch.where(late)


def last_lines(log: DataFrame, n: int = 8) -> DataFrame:
    """Newest n log lines per match."""
    w = numbered(log, ["match_id"], -F.floor(F.col("seq") / 10000), [F.col("seq").desc()], "age")
    return w.where(F.col("age") <= n).drop("age")


# --------------------------------------------------------------------------- #
# Event-time windows
# --------------------------------------------------------------------------- #
def windowed_counts(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) event-time counts per type, with a watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


#: A time after all events; a row with it closes all windows.
END = "9999-01-01 00:00:00"


def run_to_end(spark: SparkSession, events: DataFrame, counts: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Result of ``counts`` over a stream of ``events`` (ts, ...) with all windows closed, those still open at its end too.

    What is available runs first; then an end marker lands in a second source of the same query, so that the
    watermark passes every window, the last ones come out, and their state is released. ``folder`` is of no further use to a stream.
    """
    marker = spark.createDataFrame([], "ts timestamp")
    marker.write.parquet(f"{folder}/end")
    both = events.unionByName(spark.readStream.schema(marker.schema).parquet(f"{folder}/end"), allowMissingColumns=True)
    each = lambda df, i: write_batch(df.where(F.col("w.start") < F.lit("9000-01-01").cast("timestamp")), f"{folder}/out", i)
    run_available(counts(both), each, f"{folder}/checkpoint")
    spark.sql(f"SELECT timestamp '{END}' AS ts").write.mode("append").parquet(f"{folder}/end")
    run_available(counts(both), each, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
