"""Live matches as keyed state: one stateful processor holds a match from its first row to its release.

A match's state is its clock cells (the same aggregates as the batch plans use) and one row with the reading
after the last observation. It is released at full time or after a silence on the arrival clock; its cells are the compact
log of an ended match. Open matches are read from the state store of the checkpoint, so any session can
rebuild any panel from the folder alone.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pitchgrid.settings import EVENT_WEIGHTS, LATE_MINUTE, POST_GOAL_MINUTES, POST_RED_MINUTES, SHOT_TYPES, SWING, TICK, Params

#: The row that ends a match, and the one that begins it anew.
FULL_TIME, RESET = "full_time", "reset"
SUMS = ("n_events", "home_goals", "away_goals", "reds_home", "reds_away", "shots", "edge_shots")
FADING = ("press_home_0", "press_away_0")
LATEST = ("last_minute", "last_goal", "last_red")
CELL = ", ".join([*(f"{c} long" for c in SUMS), *(f"{c} double" for c in (*FADING, *LATEST))])
CELL_NAMES = (*SUMS, *FADING, *LATEST)
#: The cells of a match as they stand in its state, side by side in one value: a message to the state store costs more than the bytes.
PACKED = np.dtype([("cell", "<i4"), *((c, "<i8") for c in SUMS), *((c, "<f8") for c in (*FADING, *LATEST))])
NONE = math.nan
#: In a state: the reading after the last observation, and the cells. Spark turns a state's value into a row field by field at each
#: message, so both are packed, not a column a number.
STATE = "reading binary, cells binary"
#: clock, n_events, home and away goals, home and away reds, last_goal, last_red, home and away press; the goals, regime and momentum that
#: the next beat is held against; the last arrival and the pending timer. Not-a-number stands for none.
LAST = "<d5q4d2q16sd2q"
ARRIVED, TIMER = 14, 15
#: Before the first observation: 0-0, balanced.
BASELINE = (0.0, 0, 0, 0, 0, 0, None, None, 0.0, 0.0, 0, 0, "NORMAL", 0.5, 0, 0)
OBSERVED = "match_id string, arrived timestamp, seq long, minute double, type string, team string"
READING = "kind string, match_id string, seq long, minute double, regime string, momentum double, headline string, detail string, cell int, " + CELL
#: A match's readings of a batch leave its state side by side in one value, too: a row of its own for each costs far more than its bytes.
TOLD = "match_id string, readings binary"
PACKED_READING = np.dtype([
    ("kind", "S8"), ("numbered", "?"), ("seq", "<i8"), ("minute", "<f8"), ("regime", "S16"), ("momentum", "<f8"), ("headline", "S16"), ("detail", "S48"), *PACKED.descr])
#: Which columns a kind of reading has; the others are null.
HAS = {
    "panel": ("seq", "minute", "regime", "momentum", "headline", "detail", "n_events", "home_goals", "away_goals", "reds_home", "reds_away", *FADING, "last_goal", "last_red"),
    "late": ("seq", "minute"), "cell": ("cell", *CELL_NAMES)}


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keeps several variables a key, for the queries and readers started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def regime_at(t: float, home: int, away: int, last_goal: float | None, last_red: float | None, share: float, threshold: float) -> str:
    """The first matching game state, as in the batch plan."""
    if last_goal is not None and t - last_goal < POST_GOAL_MINUTES:
        return "POST_GOAL"
    if last_red is not None and t - last_red <= POST_RED_MINUTES:
        return "POST_RED_CARD"
    if t > LATE_MINUTE:
        return "DESPERATION" if home != away else "END_GAME"
    return "PRESSURE" if max(share, 1 - share) > threshold else "NORMAL"


def beat(home: int, away: int, regime: str, momentum: float, was: tuple) -> tuple[str | None, str | None]:
    """Headline and detail of the step from the last observation's reading ``was`` to this one; Nones if nothing turned."""
    was_home, was_away, was_regime, was_momentum = was
    side = "HOME" if momentum >= 0.5 else "AWAY"
    if home != was_home or away != was_away:
        return f"goal {'HOME' if home != was_home else 'AWAY'}", f"{home}-{away}"
    if regime != was_regime:
        return "regime shift", f"{regime} {side}"
    if (was_momentum - 0.5) * (momentum - 0.5) < 0 and abs(momentum - 0.5) > SWING:
        return "momentum swing", side
    return None, None


def newest(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


class LiveMatch(StatefulProcessor):
    """State of one match, keyed by match_id, fed with OBSERVED rows in order of arrival; its readings come out, TOLD in one row a batch.

    kind ``panel``: the reading after an observation or tick, with the beat it caused (ticks cause none). ``late``: a row whose
    minute lies more than ``lateness`` before the match's clock; it changes nothing. ``cell``: on release, each clock cell of the
    match. A ``reset`` row forgets the match. Unknown teams move the clock and count as events only. A row after full time
    opens a new state, whose cells add to the log's when it is released. A batch reads and writes the states of the
    matches it has rows of, a value of at most 100 bytes a clock minute.
    """

    def __init__(self, params: Params = Params(), step: int = 1, lateness: float | None = None, silence_ms: int = 6 * 3_600_000):
        self.params, self.step, self.lateness, self.silence_ms = params, step, lateness, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.match = handle.getValueState("match", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own, cells = restored(self.match.get())
        fresh, out = True, []
        for r in sorted(rows, key=lambda r: (r.arrived, r.seq)):
            fresh = r.type in (FULL_TIME, RESET)
            if fresh:
                if r.type == FULL_TIME:
                    out += cell_rows(cells)
                self._forget(own[TIMER])
                own, cells = list(BASELINE), {}
                continue
            own[ARRIVED] = max(own[ARRIVED], int(r.arrived.timestamp() * 1000))
            if r.minute is None:
                continue
            if self.lateness is not None and r.minute < own[0] - self.lateness:
                out.append((b"late", r.seq is not None, r.seq or 0, r.minute, *BLANK))
                continue
            self._into_cell(cells, r)
            out.append(self._observed(own, r))
        if not fresh:
            if not own[TIMER]:
                own[TIMER] = own[ARRIVED] + self.silence_ms
                self.handle.registerTimer(own[TIMER])
            self.match.update((stored(own), packed(cells)))
        yield from told(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        own, cells = restored(self.match.get())
        quiet_from = own[ARRIVED] + self.silence_ms
        if quiet_from > expiredTimerInfo.getExpiryTimeInMs():  # it has spoken since
            own[TIMER] = quiet_from
            self.handle.registerTimer(quiet_from)
            self.match.update((stored(own), packed(cells)))
        else:
            self._forget(0)
            yield from told(key[0], cell_rows(cells))

    # ---------------------------------------------------------------- state
    def _observed(self, own: list, r: Row) -> tuple:
        tau, clock = self.params.tau, max(own[0], r.minute)
        fade = math.exp((own[0] - clock) / tau)
        own[0], own[8], own[9] = clock, own[8] * fade, own[9] * fade
        home = {"HOME": True, "AWAY": False}.get(r.team)
        if r.type != TICK:
            own[1] += 1
        if home is not None:
            own[8 if home else 9] += EVENT_WEIGHTS.get(r.type, 0.0) * math.exp((r.minute - clock) / tau)
            if r.type == "goal":
                own[2 if home else 3] += 1
            elif r.type == "red_card":
                own[4 if home else 5] += 1
        if r.type == "goal":
            own[6] = newest(own[6], r.minute)
        elif r.type == "red_card":
            own[7] = newest(own[7], r.minute)
        total = own[8] + own[9]
        momentum = 0.5 if total == 0 else own[8] / total
        regime = regime_at(clock, own[2], own[3], own[6], own[7], momentum, self.params.pressure_threshold)
        headline, detail = (None, None) if r.type == TICK else beat(own[2], own[3], regime, momentum, tuple(own[10:14]))
        if r.type != TICK:
            own[10:14] = own[2], own[3], regime, momentum
        return (
            b"panel", r.seq is not None, r.seq or 0, clock, regime, momentum, headline or b"", detail or b"", 0, own[1], own[2], own[3], own[4], own[5], 0, 0, own[8], own[9], NONE,
            NONE if own[6] is None else own[6], NONE if own[7] is None else own[7])

    def _into_cell(self, cells: dict[int, list], r: Row) -> None:
        cell = math.ceil(r.minute / self.step) * self.step
        own = cells.setdefault(cell, [*(0,) * len(SUMS), 0.0, 0.0, NONE, NONE, NONE])
        home, away, goal, red, shot = r.team == "HOME", r.team == "AWAY", r.type == "goal", r.type == "red_card", r.type in SHOT_TYPES
        for i, x in enumerate((r.type != TICK, goal and home, goal and away, red and home, red and away, shot, shot and r.minute == cell)):
            own[i] += int(x)
        faded = EVENT_WEIGHTS.get(r.type, 0.0) * math.exp((r.minute - cell) / self.params.tau)
        own[7] += faded if home else 0.0
        own[8] += faded if away else 0.0
        for i, x in ((9, True), (10, goal), (11, red)):
            if x and not own[i] >= r.minute:
                own[i] = r.minute

    def _forget(self, timer: int) -> None:
        if timer:
            self.handle.deleteTimer(timer)
        self.match.clear()


def stored(own: list) -> bytes:
    return struct.pack(LAST, *own[:6], *(NONE if x is None else x for x in own[6:8]), *own[8:12], own[12].encode(), *own[13:])


def restored(state: tuple | None) -> tuple[list, dict[int, list]]:
    """The last reading and the cells of a stored state, or those of a match that has none."""
    if state is None:
        return list(BASELINE), {}
    own = list(struct.unpack(LAST, state[0]))
    own[6:8] = (None if x != x else x for x in own[6:8])
    own[12] = own[12].rstrip(b"\0").decode()
    return own, unpacked(state[1])


def packed(cells: dict[int, list]) -> bytes:
    return np.array([(cell, *values) for cell, values in sorted(cells.items())], PACKED).tobytes()


def unpacked(cells: bytes) -> dict[int, list]:
    return {cell: list(values) for cell, *values in np.frombuffer(cells, PACKED).tolist()}


#: What a late row has after its minute, and what a cell has before its number: nothing.
BLANK = (b"", NONE, b"", b"", 0, *(0,) * len(SUMS), *(NONE,) * (len(FADING) + len(LATEST)))
NO_READING = (False, 0, NONE, b"", NONE, b"", b"")


def cell_rows(cells: dict[int, list]) -> list[tuple]:
    return [(b"cell", *NO_READING, cell, *values) for cell, values in cells.items()]


def told(match_id: str, out: list[tuple]) -> Iterator[Row]:
    if out:
        yield Row(match_id=match_id, readings=np.array(out, PACKED_READING).tobytes())


def read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """READING rows of TOLD ones."""
    names = [f.split()[0] for f in READING.split(", ")]
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy() // PACKED_READING.itemsize
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), PACKED_READING)
        kinds = rows["kind"]
        of = {kind: kinds == kind.encode() for kind in HAS}

        def column(name: str) -> pa.Array:
            if name == "match_id":
                return batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            values = np.ascontiguousarray(rows[name])
            text = values.dtype.kind == "S"
            if name == "kind":
                return pa.array(values.astype("U"), pa.string())
            missing = ~np.logical_or.reduce([of[kind] for kind, has in HAS.items() if name in has])
            missing |= ~rows["numbered"] if name == "seq" else values == b"" if text else values != values
            return pa.array(values.astype("U"), pa.string(), mask=missing) if text else pa.array(values, mask=missing)

        yield pa.RecordBatch.from_arrays([column(n) for n in names], names=names)


def observations(events: DataFrame) -> DataFrame:
    """OBSERVED columns of a stream; rows without an arrival time or number get the time of their batch and 0."""
    arrived = F.col("arrived") if "arrived" in events.columns else F.current_timestamp()
    seq = F.col("seq").cast("long") if "seq" in events.columns else F.lit(0).cast("long")
    return events.where("match_id IS NOT NULL").select(
        F.col("match_id").cast("string").alias("match_id"), arrived.alias("arrived"), seq.alias("seq"), F.col("minute").cast("double").alias("minute"), "type", "team")


def readings(events: DataFrame, params: Params = Params(), *, step: int = 1, lateness: float | None = None, silence: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """READING rows of a stream of match events (arrived, seq, minute, type, team).

    The watermark is that of arrival, which the landing assigns: rows more than ``delay`` behind it have been handed in out
    of order by the landing itself and are dropped by Spark. How late a row is on the match's own clock is up to
    ``lateness``, by order of arrival, whatever batches the rows come in.
    """
    ms = int(events.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + INTERVAL {silence})").first()[0])
    marked = observations(events).withWatermark("arrived", delay)
    return marked.groupBy("match_id").transformWithState(LiveMatch(params, step, lateness, ms), TOLD, "append", "EventTime").mapInArrow(read_out, READING)


def added_cells(cells: DataFrame) -> DataFrame:
    """One row a (match, cell): what the releases of a match and its open state have counted, added up."""
    return cells.groupBy("match_id", "cell").agg(
        *[F.sum(c).alias(c) for c in (*SUMS, *FADING)], *[F.max(c).alias(c) for c in LATEST])


def open_cells(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Cells of the matches that are still open, from the state store of a stopped query's checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "match").load(checkpoint).select("key.match_id", "value.cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(c.as_py(), PACKED) for c in batch.column(1)]
            cells = np.concatenate([np.empty(0, PACKED), *each])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(cells[n]), from_pandas=True) for n in PACKED.names)], names=["match_id", *PACKED.names])

    return rows.mapInArrow(run, f"match_id string, cell int, {CELL}")
