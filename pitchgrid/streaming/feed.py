"""Polled feeds: provider snapshots as a streaming source, and each observation logged once from keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pitchgrid.sources import match_detail
from pitchgrid.streaming.keyed import FULL_TIME

#: The identity of an observation; the player is not part of it, as providers fill it in later.
POLL_KEY = ["match_id", "minute", "type", "team"]
REPORT = "match_id string, poll long, minute double, type string, team string, player_id string"
OCCURRENCE = "match_id string, minute double, type string, team string, occurrence int, player_id string, poll long"


# --------------------------------------------------------------------------- #
# Snapshots
# --------------------------------------------------------------------------- #
class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(None)
        self.names = names


def _folder(options: dict):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
    return system, path


class SnapshotReader(DataSourceReader):
    """The landed files in the order of their names; a row a line: file, json."""

    def __init__(self, options: dict):
        self.options = options

    def sizes(self) -> dict[str, int]:
        """The landed files in the order of their names, with their bytes."""
        from pyarrow import fs

        system, path = _folder(self.options)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return dict(sorted((i.path[len(path):].lstrip("/"), i.size) for i in found if i.is_file and not i.base_name.startswith(("_", "."))))

    def split(self, sizes: dict[str, int]) -> list[Files]:
        files, most = int(self.options.get("filesPerPartition", "16")), int(self.options.get("bytesPerPartition", str(4 << 20)))
        parts, held = [], 0
        for name, size in sizes.items():
            if not parts or len(parts[-1].names) >= files or held + size > most:
                parts.append(Files([]))
                held = 0
            parts[-1].names.append(name)
            held += size
        return parts

    def partitions(self) -> list[Files]:
        return self.split(self.sizes())

    def read(self, partition: Files) -> Iterator[tuple]:
        system, path = _folder(self.options)
        for name in partition.names:
            with system.open_input_stream(f"{path}/{name}") as lines:
                for line in lines.read().decode("utf-8").splitlines():
                    if line.strip():
                        yield name, line


class SnapshotStream(SnapshotReader, DataSourceStreamReader):
    """Offsets are file names: a batch is what has landed with a greater name than the last one's."""

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(self.sizes(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.split({n: size for n, size in self.sizes().items() if start["file"] < n <= end["file"]})


class MatchSnapshots(DataSource):
    """``spark.read`` / ``spark.readStream`` ``.format("match_snapshots")`` over a folder of landed provider snapshots.

    Files are JSON lines, one match snapshot a line, and land once, under paths that ascend (a subfolder a poll, its number with
    leading zeros, say) in a folder that every executor can reach. Options ``filesPerPartition`` (16) and ``bytesPerPartition``
    (4 MB; a larger file is a task of its own) bound the work of a task.
    """

    @classmethod
    def name(cls) -> str:
        return "match_snapshots"

    def schema(self) -> str:
        return "file string, json string"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)

    def streamReader(self, schema) -> SnapshotStream:
        return SnapshotStream(self.options)


def read_snapshots(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Snapshots of a folder with their provider's fields, batch or stream: file and the columns of a match detail."""
    spark.dataSource.register(MatchSnapshots)
    reader = spark.readStream if stream else spark.read
    return match_detail.parse_details(reader.format("match_snapshots").load(path))


def reports(snapshots: DataFrame, poll) -> DataFrame:
    """REPORT rows of snapshots: goals, cards, substitutions, and the end of finished matches. ``poll`` numbers a snapshot."""
    marked = snapshots.withColumn("poll", poll.cast("long"))
    rows = match_detail.events_from_details(marked, ["poll"])
    ends = marked.where("status = 'FINISHED'").select(
        "poll", F.col("id").cast("string").alias("match_id"), F.lit(None).cast("double").alias("minute"), F.lit(None).cast("string").alias("team"), F.lit(FULL_TIME).alias("type"),
        F.lit(None).cast("string").alias("player_id"))
    return rows.unionByName(ends)


# --------------------------------------------------------------------------- #
# Occurrences
# --------------------------------------------------------------------------- #
class Occurrences(StatefulProcessor):
    """Occurrences of the observations of one match, keyed by match_id, fed with REPORT rows in any split and order.

    An observation has happened as often as the poll that reports it most often says; the occurrences of a poll are numbered by
    player, unnamed ones last, and the latest poll that names an occurrence wins. Rows of a poll may come in any number of
    batches: the players reported by a poll are kept until the match ends. A match's observations are one value and the reports
    of a poll another, both as JSON, as a message to the state store and each of its fields cost more than the bytes: a batch reads
    and writes what is known of its matches and the polls that it brings. New or newly named occurrences come out. A FULL_TIME row
    releases the match after the rest of its batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "names string")
        self.reported = handle.getMapState("reported", "poll long", "players string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, dict[tuple, list]] = {}
        ended = False
        for r in rows:
            if r.type == FULL_TIME:
                ended = True
            else:
                new.setdefault(r.poll, {}).setdefault((r.minute, r.type, r.team), []).append(r.player_id)
        known = _read(self.known.get())
        before = {what: list(known.get(what, ())) for whats in new.values() for what in whats}
        for poll, whats in sorted(new.items(), key=lambda x: (x[0] is not None, x[0])):
            reported = _read(self.reported.getValue((poll,)))
            for what, players in whats.items():
                reported[what] = sorted([*reported.get(what, ()), *players], key=lambda p: (p is None, p or ""))
                names = known.setdefault(what, [])
                names += [[-1, None]] * (len(reported[what]) - len(names))
                for i, player in enumerate(reported[what]):
                    if player is not None and poll >= names[i][0]:
                        names[i] = [poll, player]
            if not ended:
                self.reported.updateValue((poll,), (_written(reported),))
        for what, was in sorted(before.items(), key=str):
            for i, (poll, player) in enumerate(known[what]):
                if i >= len(was) or was[i] != [poll, player]:
                    yield Row(match_id=key[0], minute=what[0], type=what[1], team=what[2], occurrence=i + 1, player_id=player, poll=poll)
        if ended:
            self.known.clear()
            self.reported.clear()
        elif any(known[what] != was for what, was in before.items()):
            self.known.update((_written(known),))


def _written(values: dict[tuple, list]) -> str:
    return json.dumps([[*what, value] for what, value in values.items()])


def _read(stored: tuple | None) -> dict[tuple, list]:
    """Values by (minute, type, team), as they were written."""
    return {tuple(what): value for *what, value in json.loads(stored[0])} if stored else {}


def occurrences(polls: DataFrame) -> DataFrame:
    """OCCURRENCE rows of a stream of REPORT rows."""
    rows = polls.where("match_id IS NOT NULL").select(
        F.col("match_id").cast("string").alias("match_id"), F.col("poll").cast("long").alias("poll"), F.round("minute", 3).alias("minute"), "type", "team",
        F.col("player_id").cast("string").alias("player_id"))
    return rows.groupBy("match_id").transformWithState(Occurrences(), OCCURRENCE, "append", "None")
