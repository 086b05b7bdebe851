"""What a batch of a match costs in messages to the state store and in rows between Spark and Python."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from pitchgrid.streaming import feed, keyed


class Handle:
    """The state of one key in a dict; counts what would be messages."""

    def __init__(self):
        self.kept, self.messages, self.schemas = {}, 0, {}

    def getValueState(self, name, schema):
        self.schemas[name] = schema
        return Variable(self, name)

    def getMapState(self, name, key, value):
        return Variable(self, name)

    def registerTimer(self, at):
        self.messages += 1

    deleteTimer = registerTimer


class Variable:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def getValue(self, key):
        self.handle.messages += 1
        return self.handle.kept.get((self.name, key))

    def updateValue(self, key, value):
        self.handle.messages += 1
        self.handle.kept[self.name, key] = value

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def clear(self):
        self.handle.messages += 1
        self.handle.kept = {k: v for k, v in self.handle.kept.items() if k[0] != self.name}


def test_a_poll_costs_the_same_messages_however_much_it_reports():
    handle, processor = Handle(), feed.Occurrences()
    processor.init(handle)
    rows = lambda poll, n: [Row(match_id="m", poll=poll, minute=float(i // 2), type="foul", team="HOME", player_id=f"p{i}" if poll else None) for i in range(n)]
    assert len(list(processor.handleInputRows(("m",), iter(rows(0, 40)), None))) == 40
    assert handle.messages <= 4
    handle.messages = 0
    out = list(processor.handleInputRows(("m",), iter(rows(1, 60)), None))
    assert handle.messages <= 4 and len(out) == 60
    assert sorted((r.minute, r.occurrence, r.player_id) for r in out)[:3] == [(0.0, 1, "p0"), (0.0, 2, "p1"), (1.0, 1, "p2")]


def test_large_snapshot_files_are_read_in_tasks_of_their_own():
    split = lambda **options: [p.names for p in feed.SnapshotReader(options).split({"a": 9 << 20, "b": 1 << 20, "c": 1 << 20, "d": 3 << 20})]
    assert split() == [["a"], ["b", "c"], ["d"]]
    assert split(filesPerPartition="1") == [["a"], ["b"], ["c"], ["d"]]
    assert feed.SnapshotReader({}).split({}) == []


def test_a_batch_of_a_match_leaves_as_one_row_and_reads_out_whole():
    handle, processor = Handle(), keyed.LiveMatch(lateness=6.0)
    processor.init(handle)
    assert handle.schemas["match"].count(",") <= 1
    at = lambda i: dt.datetime(2024, 1, 1, 15, i)
    items = [(10.0, "red_card", "AWAY"), (20.0, "shot", "HOME"), (3.0, "goal", "HOME"), (21.0, "goal", "HOME")]
    told = list(processor.handleInputRows(("m",), iter([Row(match_id="m", arrived=at(i), seq=i or None, minute=m, type=t, team=s) for i, (m, t, s) in enumerate(items)]), None))
    told += processor.handleInputRows(("m",), iter([Row(match_id="m", arrived=at(9), seq=9, minute=None, type=keyed.FULL_TIME, team=None)]), None)
    assert len(told) == 2
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in told], pa.schema([("match_id", pa.string()), ("readings", pa.binary())]))
    rows = pa.Table.from_batches(keyed.read_out([batch])).to_pylist()
    assert [(r["kind"], r["seq"], r["minute"], r["regime"], r["headline"], r["detail"], r["last_goal"], r["last_red"]) for r in rows[:4]] == [
        ("panel", None, 10.0, "POST_RED_CARD", "regime shift", "POST_RED_CARD HOME", None, 10.0), ("panel", 1, 20.0, "POST_RED_CARD", None, None, None, 10.0),
        ("late", 2, 3.0, None, None, None, None, None), ("panel", 3, 21.0, "POST_GOAL", "goal HOME", "1-0", 21.0, 10.0)]
    assert [(r["kind"], r["cell"], r["n_events"], r["home_goals"], r["last_goal"], r["minute"]) for r in rows[4:]] == [
        ("cell", 10, 1, 0, None, None), ("cell", 20, 1, 0, None, None), ("cell", 21, 1, 1, 21.0, None)]
    assert rows[2]["n_events"] is None and rows[0]["cell"] is None and {r["match_id"] for r in rows} == {"m"}
    own, cells = keyed.restored((keyed.stored(list(keyed.BASELINE)), keyed.packed({3: [*range(7), 1.0, 2.0, 3.0, np.nan, np.nan]})))
    assert own == list(keyed.BASELINE) and cells[3][:10] == [*range(7), 1.0, 2.0, 3.0]
