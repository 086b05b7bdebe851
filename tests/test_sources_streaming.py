import json

import pytest
from pyspark.sql import functions as F

from pitchgrid.plans import snapshots as S
from pitchgrid.sources import match_detail, open_format, provider_events, results, tables
from pitchgrid.streaming import live


@pytest.fixture
def heads(spark):
    return spark.createDataFrame([("7", "Reds", "Blues")], "match_id string, home_team string, away_team string")


def _file(path, rows):
    path.write_text(json.dumps(rows), encoding="utf-8")
    return str(path)


def test_provider_file(spark, heads, tmp_path):
    ev = lambda no, kind, team="Reds", **kw: {"event_no": no, "minute": 10, "second": 30, "period": 1, "type": {"name": kind}, "team": {"name": team}, "player": {"id": 5, "name": "P"}, **kw}
    path = _file(tmp_path / "events_7.json", [
        ev(1, "Shot", shot={"outcome": {"name": "Goal"}, "statsbomb_xg": 0.4, "end_location": [120, 40]}, location=[60, 40]),
        ev(2, "Shot", "Blues", shot={"outcome": {"name": "Saved"}}), ev(3, "Shot", shot={"outcome": {"name": "Blocked"}}),
        ev(4, "Pass", **{"pass": {"type": {"name": "Corner"}, "recipient": {"id": 9}, "end_location": [90, 40]}}, location=[60, 40]),
        ev(5, "Foul Committed", foul_committed={"card": {"name": "Second Yellow"}}), ev(6, "Bad Behaviour", "Blues", bad_behaviour={"card": {"name": "Yellow Card"}}),
        ev(7, "Shot", "Others", shot={"outcome": {"name": "Goal"}}), {**ev(8, "Shot", shot={"outcome": {"name": "Goal"}}), "period": 5},
        ev(9, "Own Goal For", "Blues"), ev(10, "Pressure")])
    raw = provider_events.read_raw(spark, path)
    got = provider_events.normalize(raw, heads).collect()
    assert sorted((r.event_no, r.team, r.type) for r in got) == [
        (1, "HOME", "goal"), (1, "HOME", "shot_on_target"), (2, "AWAY", "shot_on_target"), (3, "HOME", "shot"), (4, "HOME", "corner"),
        (5, "HOME", "foul"), (5, "HOME", "red_card"), (6, "AWAY", "yellow_card"), (9, "AWAY", "goal")]
    first = [r for r in got if r.type == "goal" and r.team == "HOME"][0]
    assert (first.minute, first.x, first.y, first.xg, first.player_id) == (10.5, 50.0, 50.0, 0.4, "5")
    assert 9 not in {r.event_no for r in provider_events.normalize(raw, heads, own_goals=False).collect()}
    stream = {r.event_no: r for r in provider_events.ball_stream(raw, heads).collect()}
    assert set(stream) == {1, 4} and stream[4].x2 == 75.0 and stream[1].outcome == "Goal" and stream[1].t == 630.0
    passed = provider_events.pass_records(raw).first()
    assert (passed.src, passed.dst, passed.success) == ("5", "9", True)


def test_detail_file(spark, tmp_path):
    team = {"id": 1, "name": "A"}
    doc = {"id": 3, "homeTeam": team, "awayTeam": {"id": 2, "name": "B"}, "minute": None,
           "goals": [{"minute": 5, "team": team, "scorer": {"id": 8}}, {"minute": 9, "team": {"name": "B"}}, {"minute": None, "team": team}, {"minute": 7, "team": {"id": 77, "name": "X"}}],
           "bookings": [{"minute": 50, "team": team, "card": "YELLOW_RED", "player": {"id": 4}}, {"minute": 51, "team": team, "card": "BLUE"}], "substitutions": []}
    d = match_detail.read_details(spark, _file(tmp_path / "d.json", [doc]))
    got = sorted((r.minute, r.team, r.type, r.player_id) for r in match_detail.events_from_details(d).collect())
    assert got == [(5.0, "HOME", "goal", "8"), (9.0, "AWAY", "goal", None), (50.0, "HOME", "red_card", "4")]
    assert match_detail.live_clock(d).first().minute == 51.0


def test_results_files(spark, tmp_path):
    csv = "Date,HomeTeam,AwayTeam,FTHG,FTAG,HTHG,HTAG,HC,AC,HY,AY,HR,AR\n"
    csv += "05/08/23,Köln,Bo,1,0,0,0,1,2,3,4,0,0\n17/09/2023,A,B,x,0,0,0,1,2,3,4,0,0\n31/02/23,A,B,1,0,0,0,1,2,3,4,0,0\n"
    (tmp_path / "r.csv").write_bytes(csv.encode("latin-1"))
    rows = results.results_records(results.read_results_csv(spark, str(tmp_path / "r.csv")), "fd").collect()
    assert [(str(r.date), r.home, r.home_goals) for r in rows] == [("2023-08-05", "Köln", 1)]
    m = lambda d, ft, ht: {"date": d, "team1": "A", "team2": "B", "score": {"ft": ft, "ht": ht}}
    flat = _file(tmp_path / "a.json", {"matches": [m("2023-08-05", [2, 1], None), {"date": "2023-08-06", "team1": "A", "team2": "B"}]})
    rounds = _file(tmp_path / "b.json", {"rounds": [{"matches": [m("2023-08-07", [0, 0], [0, 0])]}, {"matches": []}]})
    got = [r for f in (flat, rounds) for r in results.community_records(results.read_community_json(spark, f), "of").collect()]
    assert [(str(r.date), r.home_goals, r.ht_home) for r in got] == [("2023-08-05", 2, None), ("2023-08-07", 0, 0)]


def test_open_format_reports_every_reject(spark, tmp_path):
    head = "match_id,date,home_team,away_team,minute,team,type,x,y,player_id\n"
    ok = "m,2024-01-01,A,B,{},{},{},{},{},p\n"
    body = [ok.format(0, "home", "goal", 0, 100), ok.format("nan", "HOME", "goal", 1, 1), ok.format("abc", "HOME", "goal", 1, 1), ok.format(151, "HOME", "goal", 1, 1),
            ok.format(5, "LEFT", "goal", 1, 1), ok.format(5, "HOME", "throw", 1, 1), ok.format(5, "HOME", "goal", 101, 1), ok.format(5, "HOME", "goal", 1, "q"), ",,A,B,5,HOME,goal,1,1,p\n"]
    (tmp_path / "e.csv").write_text(head + "".join(body))
    checked = open_format.validate(open_format.read_text_rows(spark, str(tmp_path / "e.csv")))
    valid = open_format.valid_rows(checked).collect()
    assert [(r.minute, r.team, r.x) for r in valid] == [(0.0, "HOME", 0.0)]
    assert sorted(r.reject_reason for r in open_format.rejects(checked).collect()) == sorted([
        "minute outside 0-150", "minute is not a number", "minute outside 0-150", "unknown side LEFT", "unknown type throw", "x outside 0-100", "y is not a number", "missing match_id,date"])
    numeric = _file(tmp_path / "e.json", [{"match_id": "m", "date": "2024-01-01", "home_team": "A", "away_team": "B", "minute": 0, "team": "HOME", "type": "goal", "x": 0}])
    assert open_format.valid_rows(open_format.validate(open_format.read_text_rows(spark, numeric))).count() == 1


def test_tracking_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t,player_id,team,x,y,player\n1.5,p,HOME,10,20,Ann\nx,p,HOME,1,2,\n2,p,HOME,,2,\n")
    rows = open_format.frames(open_format.read_tracking(spark, str(tmp_path / "t.csv"))).collect()
    assert [(r.t, r.x, r.player) for r in rows] == [(1.5, 10.0, "Ann")]
    f = _file(tmp_path / "t.json", {"frames": [{"t": 1, "player_id": "p", "team": "HOME", "x": 1, "y": 2}]})
    assert open_format.frames(open_format.read_tracking(spark, f)).count() == 1


def test_partition_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.write_partitions(df, path, ["k"])
    for _ in range(2):
        tables.write_partitions(df.where("k = 'b'").withColumn("v", F.lit(9)), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


SCHEMA = "match_id string, minute double, team string, type string"


def _drop(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_for_disordered_events_and_restarts(spark, tmp_path):
    rows = [("m", 3.0 + 7 * (i * 5 % 12), "HOME" if i % 2 else "AWAY", ["shot", "goal", "corner", "red_card"][i % 4]) for i in range(12)]
    landed, state = str(tmp_path / "in"), str(tmp_path / "state")
    _drop(spark, landed, rows[:5])
    live.stream_panels(spark, live.read_files(spark, landed, SCHEMA), state)
    _drop(spark, landed, rows[5:])                                       # second run resumes from the checkpoint
    got = live.stream_panels(spark, live.read_files(spark, landed, SCHEMA), state)
    want = S.panel(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: [(r.minute, r.regime, r.n_events, round(r.momentum, 9), round(r.goal_next_10min, 9), r.because) for r in df.orderBy("minute").collect()]
    assert key(got) == key(want)


def test_ticks_move_the_clock_only(spark, tmp_path):
    rows = [("m", 10.0, "HOME", "goal"), ("m", 20.0, None, "tick")]
    landed = str(tmp_path / "in")
    _drop(spark, landed, rows)
    panel = live.current_panels(live.stream_panels(spark, live.read_files(spark, landed, SCHEMA), str(tmp_path / "s"))).first()
    assert panel.minute == 20 and panel.n_events == 1 and panel.home_goals == 1
    assert live.live_clock(spark.createDataFrame(rows, SCHEMA)).first().clock == 20.0


def test_polls_are_fed_once_and_braces_survive(spark, tmp_path):
    schema = "match_id string, minute double, type string, team string, player_id string, poll int"
    goal = lambda minute, player, poll: ("m", minute, "goal", "HOME", player, poll)
    landed, folder = str(tmp_path / "in"), str(tmp_path / "s")
    _drop(spark, landed, [goal(30.0, None, 0)], schema)
    _drop(spark, landed, [goal(30.0, "p9", 1)], schema)                   # same goal, scorer filled in
    _drop(spark, landed, [goal(30.0, "p9", 2), goal(30.0, "p7", 2), goal(55.0, "p9", 2)], schema)
    log = live.feed_polls(spark, live.read_files(spark, landed, schema, files_per_batch=1), folder)
    assert sorted(r.minute for r in log.collect()) == [30.0, 30.0, 55.0]
    again = live.feed_polls(spark, live.read_files(spark, landed, schema, files_per_batch=1), folder)
    assert again.count() == 3


def test_a_poll_in_several_batches_is_numbered_as_a_whole(spark, tmp_path):
    schema = "match_id string, minute double, type string, team string, player_id string, poll int"
    landed, folder = str(tmp_path / "in"), str(tmp_path / "s")
    for poll in (0, 1):
        for player in ("p9", "p7"):
            _drop(spark, landed, [("m", 30.0, "goal", "HOME", player if poll else None, poll)], schema)
    log = live.feed_polls(spark, live.read_files(spark, landed, schema, files_per_batch=1), folder)
    assert sorted((r.occurrence, r.player_id) for r in log.collect()) == [(1, "p7"), (2, "p9")]


def test_late_rows_are_routed(spark):
    import datetime as dt
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(0), at(100)), (2, at(95), at(100))], "i int, a timestamp, n timestamp")
    on_time, late = live.split_late(df, F.col("a"), F.col("n"), 60)
    assert [r.i for r in on_time.collect()] == [2] and [r.i for r in late.collect()] == [1]
