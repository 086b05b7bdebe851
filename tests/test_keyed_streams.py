"""Keyed state of live matches and polled feeds: beats, late rows, release, restarts, the snapshot source."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitchgrid.plans import snapshots as S
from pitchgrid.streaming import feed, keyed, live

SCHEMA = "match_id string, arrived timestamp, seq long, minute double, type string, team string"
START = dt.datetime(2024, 1, 1, 15, 0)


@pytest.fixture(autouse=True)
def one_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def rows_of(match, items, hour=0):
    """(minute, type, team) in order of arrival, a minute apart."""
    return [(match, START + dt.timedelta(hours=hour, minutes=i), i, None if m is None else float(m), kind, team) for i, (m, kind, team) in enumerate(items)]


@pytest.fixture
def run(spark, tmp_path):
    landed, folder = str(tmp_path / "in"), str(tmp_path / "live")

    def go(rows, **options):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        live.follow_matches(spark, live.read_files(spark, landed, SCHEMA, files_per_batch=1), folder, **options)
        with keyed.keyed_state(spark):
            return folder, keyed.open_cells(spark, f"{folder}/checkpoint").select("match_id").distinct().count()
    return go


def beats(spark, folder):
    return [(r.match_id, r.minute, r.headline, r.detail) for r in live.logged(spark, folder, "panel").orderBy("match_id", "seq").collect()]


def test_beats_follow_observations_from_the_baseline(spark, run):
    items = [(1, "goal", "HOME"), (1, "goal", "AWAY"), (30, "tick", None), (40, "shot", "AWAY"), (41, "shot_on_target", "HOME"), (39, "goal", "HOME"), (41, "red_card", "AWAY")]
    folder, open_now = run(rows_of("m", items))
    assert beats(spark, folder) == [
        ("m", 1.0, "goal HOME", "1-0"), ("m", 1.0, "goal AWAY", "1-1"), ("m", 30.0, None, None), ("m", 40.0, "regime shift", "PRESSURE AWAY"), ("m", 41.0, None, None),
        ("m", 41.0, "goal HOME", "2-1"), ("m", 41.0, None, None)]
    assert open_now == 1


def test_full_time_releases_a_match_and_its_log_rebuilds_the_panel(spark, run):
    items = [(3 + 7 * (i * 5 % 12), ["shot", "goal", "corner", "red_card"][i % 4], "HOME" if i % 2 else "AWAY") for i in range(12)]
    rows = rows_of("a", items) + rows_of("b", items)
    assert run(rows[:9])[1] == 1 and run(rows[9:])[1] == 2
    folder, open_now = run([("a", START + dt.timedelta(minutes=20), 50, None, keyed.FULL_TIME, None)])
    assert open_now == 1 and {r.match_id for r in live.logged(spark, folder, "cell").collect()} == {"a"}
    folder, open_now = run([("b", START + dt.timedelta(minutes=21), 50, None, keyed.FULL_TIME, None)])
    assert open_now == 0
    want = S.panel(spark.createDataFrame([(r[0], r[3], r[5], r[4]) for r in rows], "match_id string, minute double, team string, type string"))
    key = lambda df: [(r.match_id, r.minute, r.regime, r.n_events, round(r.momentum, 9), round(r.goal_next_10min, 9), r.because) for r in df.orderBy("match_id", "minute").collect()]
    log = live.logged(spark, folder, "cell")
    assert log.count() == log.select("match_id", "cell").distinct().count()
    assert key(live.panels_from_cells(live.current_cells(spark, folder))) == key(want)
    # A straggler opens the match again and adds to its cells.
    folder, open_now = run(rows_of("a", [(10, "goal", "HOME")], hour=1))
    again = live.current_panels(live.panels_from_cells(live.current_cells(spark, folder))).where("match_id = 'a'").first()
    assert open_now == 1 and again.n_events == 13


def test_silence_releases_a_match(spark, run):
    assert run(rows_of("a", [(1, "goal", "HOME")]), silence="2 hours", delay="1 minute")[1] == 1
    assert run(rows_of("a", [(50, "shot", "HOME")], hour=1), silence="2 hours", delay="1 minute")[1] == 1
    folder, open_now = run(rows_of("b", [(1, "goal", "HOME")], hour=2.5), silence="2 hours", delay="1 minute")
    assert open_now == 2                                                  # a spoke at 16:00
    folder, open_now = run(rows_of("b", [(2, "goal", "HOME")], hour=4), silence="2 hours", delay="1 minute")
    assert open_now == 1 and {(r.match_id, r.cell) for r in live.logged(spark, folder, "cell").collect()} == {("a", 1), ("a", 50)}


def test_late_rows_come_out_beside_the_panels(spark, run):
    items = [(20, "shot", "HOME"), (15, "goal", "HOME"), (31, "shot", "AWAY"), (15, "goal", "AWAY"), (21, "corner", "HOME")]
    rows = rows_of("m", items)
    run(rows[:3], lateness=10.0)
    folder, _ = run(rows[3:], lateness=10.0)
    late = [(r.seq, r.minute) for r in live.logged(spark, folder, "late").collect()]
    on_time = sorted(r.seq for r in live.logged(spark, folder, "panel").collect())
    assert late == [(3, 15.0)] and on_time == [0, 1, 2, 4]
    last = live.current_panels(live.panels_from_cells(live.current_cells(spark, folder))).first()
    assert (last.home_goals, last.away_goals, last.n_events) == (1, 0, 4)


def test_reset_forgets_a_match(spark, run):
    folder, open_now = run(rows_of("m", [(20, "goal", "HOME"), (None, keyed.RESET, None), (5, "goal", "AWAY")]))
    last = live.current_panels(live.panels_from_cells(live.current_cells(spark, folder))).first()
    assert (open_now, last.minute, last.home_goals, last.away_goals) == (1, 5, 0, 1)
    assert beats(spark, folder)[-1][2:] == ("goal AWAY", "0-1")


def test_a_finished_poll_releases_what_was_reported(spark, tmp_path):
    schema = feed.REPORT
    landed, folder = str(tmp_path / "in"), str(tmp_path / "s")

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        log = live.feed_polls(spark, live.read_files(spark, landed, schema, files_per_batch=1), folder)
        with keyed.keyed_state(spark):
            left = spark.read.format("statestore").option("stateVarName", "reported").load(f"{folder}/checkpoint").count()
        return sorted((r.minute, r.type, r.occurrence, r.player_id) for r in log.collect()), left

    assert go([("m", 2, 30.0, "substitution", "HOME", "p2")]) == ([(30.0, "substitution", 1, "p2")], 1)
    late_poll = [("m", 1, 30.0, "substitution", "HOME", "p9"), ("m", 1, 30.0, "substitution", "HOME", None)]
    assert go(late_poll) == ([(30.0, "substitution", 1, "p2"), (30.0, "substitution", 2, None)], 2)
    got, left = go([("m", 3, 30.0, "substitution", "HOME", "p2"), ("m", 3, 30.0, "substitution", "HOME", "p9"), ("m", 3, None, keyed.FULL_TIME, None, None)])
    assert got == [(30.0, "substitution", 1, "p2"), (30.0, "substitution", 2, "p9")] and left == 0


def _snapshot(folder, poll, **match):
    where = folder / f"poll={poll:06d}"
    where.mkdir(parents=True)
    base = {"id": 7, "homeTeam": {"id": 1}, "awayTeam": {"id": 2}, "goals": [], "bookings": [], "substitutions": []}
    (where / "part-0.json").write_text(json.dumps({**base, **match}) + "\n\n")


def test_snapshots_stream_from_the_last_offset(spark, tmp_path):
    landed, folder = tmp_path / "snaps", str(tmp_path / "s")
    goal = {"minute": 10, "team": {"id": 1}, "scorer": {"id": 9}}
    change = {"minute": 46, "team": {"id": 2}, "playerIn": {"id": 5}}

    def go():
        polls = feed.reports(feed.read_snapshots(spark, str(landed), stream=True), F.regexp_extract("file", "poll=([0-9]+)", 1))
        return sorted((r.minute, r.type, r.team, r.occurrence, r.player_id) for r in live.feed_polls(spark, polls, folder).collect())

    _snapshot(landed, 1, goals=[{**goal, "scorer": None}])
    assert go() == [(10.0, "goal", "HOME", 1, None)]
    _snapshot(landed, 2, goals=[goal, goal], substitutions=[change])
    first = go()
    assert first == [(10.0, "goal", "HOME", 1, "9"), (10.0, "goal", "HOME", 2, "9"), (46.0, "substitution", "AWAY", 1, "5")]
    assert go() == first                                                  # nothing new has landed
    _snapshot(landed, 3, goals=[goal], status="FINISHED")
    assert go() == first
    batch = feed.read_snapshots(spark, f"file://{landed}")
    assert batch.count() == 3 and [r.file for r in batch.orderBy("file").collect()][0] == "poll=000001/part-0.json"


def test_an_end_marker_closes_windows_and_sessions(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = [(1, at(0), 1, "a"), (2, at(5), 1, "a"), (3, at(400), 2, "b"), (4, at(405), None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: live.read_files(spark, str(tmp_path / "in"), schema).select("ts", "user_id", "event_type")
    counts = live.run_to_end(spark, stream(), lambda e: live.windowed_counts(e, "1 hour"), str(tmp_path / "w"))
    assert sorted(((r.event_type, r.n) for r in counts.collect()), key=str) == [("a", 2), ("b", 1), (None, 1)]
    sessions = live.run_to_end(spark, stream(), lambda e: live.session_counts(e, "6 hours"), str(tmp_path / "s"))
    assert sorted(((r.user_id, r.n) for r in sessions.collect()), key=str) == [(1, 2), (2, 1), (None, 1)]
