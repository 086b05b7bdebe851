"""Queries that run the given events through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchgrid.bindings import state_sql as Q
from pitchgrid.bindings.registry import query
from pitchgrid.bindings.tables import START_MICROS, match_events
from pitchgrid.functions.clock import naive_micros, naive_text
from pitchgrid.plans import matches as M
from pitchgrid.plans import snapshots as S
from pitchgrid.shared import cut, new_folder
from pitchgrid.streaming import feed, keyed, live

EV = ("match_events",)


#: When an event reaches us: up to three minutes after it happened, every 23rd one twelve minutes later still; in microseconds.
ARRIVAL = "CAST(FLOOR((minute + ((event_id * 7919) % 97) / 97.0D * 3 + CASE WHEN event_id % 23 = 0 THEN 12 ELSE 0 END) * 60000000) AS BIGINT)"
ARRIVED = f"""
arrivals AS (SELECT *, {ARRIVAL.replace('97.0D', '97.0::DOUBLE')} AS arrived FROM match_events)"""


def _landed(spark, d, slices: int = 4, ended: str = "true"):
    """The match events as landed files, a slice of the arrival clock after the other; a full-time row ends the matches that ``ended`` names."""
    path = new_folder(spark, "landed")
    micros = F.expr(ARRIVAL)
    ev = match_events(spark, d).select("match_id", F.col("event_id").alias("seq"), "minute", "type", "team", micros.alias("micros"))
    ends = match_events(spark, d).where(ended).groupBy("match_id").agg(F.max(micros).alias("micros"), F.max("event_id").alias("seq")).select(
        "match_id", (F.col("seq") + 1).alias("seq"), F.lit(None).cast("double").alias("minute"), F.lit(keyed.FULL_TIME).alias("type"), F.lit(None).cast("string").alias("team"), (F.col("micros") + 1).alias("micros"))
    rows = ev.withColumn("slice", F.least(F.lit(slices - 1), F.floor(F.col("micros") / 6e9 * slices))).unionByName(ends.withColumn("slice", F.lit(slices - 1)))
    rows = rows.withColumn("arrived", F.timestamp_micros(F.lit(START_MICROS) + F.col("micros"))).drop("micros")
    rows = cut(rows)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(slices):
        rows.where(F.col("slice") == i).drop("slice").repartition(width, "match_id").write.mode("append").parquet(path)
    return path, rows.drop("slice").schema, width


def _followed(spark, d, ended: str = "true", **options) -> str:
    path, schema, width = _landed(spark, d, ended=ended)
    folder = new_folder(spark, "live")
    live.follow_matches(spark, live.read_files(spark, path, schema, files_per_batch=width), folder, **options)
    return folder


def _streamed(spark, d, ended: str = "true"):
    return live.panels_from_cells(live.current_cells(spark, _followed(spark, d, ended)))


PANEL_COLS = ["match_id", "minute", "home_goals", "away_goals", "n_events", "regime", "momentum", "recent_shots", "goal_next_10min", "confidence", "change_score"]
PANEL_SQL = Q.PANEL + """ SELECT match_id, t AS minute, home_goals, away_goals, n_events, regime, R(momentum) AS momentum, recent_shots, R(1 - exp(-lam * 10)) AS goal_next_10min,
  R(confidence) AS confidence, change_score FROM panels"""


@query("t01_t06_streamed_panels", PANEL_SQL, EV)
def t01(spark, d):
    return _streamed(spark, d).select(*PANEL_COLS)


@query("t06_stream_equals_batch", "SELECT 0::BIGINT AS only_stream, 0::BIGINT AS only_batch, (SELECT count(*) FROM events) AS n_events")
def t06(spark, d):
    """Rows found on one side only, after rounding to 9 digits: none."""
    def comparable(p):
        return p.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in p.select(*PANEL_COLS).dtypes])
    stream, batch = comparable(_streamed(spark, d)), comparable(S.panel(match_events(spark, d)))
    both = stream.withColumn("s", F.lit(1)).unionByName(batch.withColumn("s", F.lit(-1)))
    diff = both.groupBy(*PANEL_COLS).agg(F.sum("s").alias("s"))
    n = match_events(spark, d).agg(F.count("*").alias("n_events"))
    return diff.agg(F.count_if(F.col("s") > 0).alias("only_stream"), F.count_if(F.col("s") < 0).alias("only_batch")).join(n)


@query("t03_t07_current_panels", Q.PANEL + """ SELECT match_id, t AS minute, regime, R(momentum) AS momentum FROM panels QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY t DESC) = 1""", EV)
def t03(spark, d):
    """Rebuilt from the folder alone, with every other match still open: the log has those that ended, the state store the others."""
    panels = _streamed(spark, d, "match_no % 2 = 0")
    return live.current_panels(panels).select("match_id", "minute", "regime", "momentum")


@query("t05_live_beats", Q.PANEL + """, st AS (SELECT *, lag(home_goals) OVER w AS wh, lag(away_goals) OVER w AS wa, lag(regime) OVER w AS wr, lag(momentum) OVER w AS wm FROM panels WINDOW w AS (PARTITION BY match_id ORDER BY t))
  SELECT match_id, t AS minute, headline FROM (SELECT match_id, t, CASE WHEN home_goals <> wh OR away_goals <> wa THEN 'goal ' || CASE WHEN home_goals <> wh THEN 'HOME' ELSE 'AWAY' END
    WHEN regime <> wr THEN 'regime shift' WHEN (wm - 0.5) * (momentum - 0.5) < 0 AND abs(momentum - 0.5) > 0.2 THEN 'momentum swing' END AS headline FROM st WHERE wr IS NOT NULL) WHERE headline IS NOT NULL""", EV)
def t05(spark, d):
    return M.transition_beats(_streamed(spark, d)).select("match_id", "minute", "headline")


OBSERVED = ARRIVED + f""", seen AS (
  SELECT *, max(minute) OVER w AS clock, count(*) FILTER (type = 'goal' AND team = 'HOME') OVER w AS home_goals, count(*) FILTER (type = 'goal' AND team = 'AWAY') OVER w AS away_goals,
    max(minute) FILTER (type = 'goal') OVER w AS last_goal, max(minute) FILTER (type = 'red_card') OVER w AS last_red,
    coalesce(sum({Q.WEIGHT} * exp(minute / 8.0::DOUBLE)) FILTER (team = 'HOME') OVER w, 0) AS grown_home, coalesce(sum({Q.WEIGHT} * exp(minute / 8.0::DOUBLE)) FILTER (team = 'AWAY') OVER w, 0) AS grown_away
  FROM arrivals e WINDOW w AS (PARTITION BY match_id ORDER BY arrived, event_id ROWS UNBOUNDED PRECEDING)
), read AS (
  SELECT *, CASE WHEN grown_home + grown_away = 0 THEN 0.5 ELSE grown_home / (grown_home + grown_away) END AS momentum FROM seen
), told AS (
  SELECT *, CASE WHEN clock - last_goal < 5 THEN 'POST_GOAL' WHEN clock - last_red <= 10 THEN 'POST_RED_CARD' WHEN clock > 80 AND home_goals <> away_goals THEN 'DESPERATION' WHEN clock > 80 THEN 'END_GAME'
      WHEN greatest(momentum, 1 - momentum) > 0.65 THEN 'PRESSURE' ELSE 'NORMAL' END AS regime FROM read
), steps AS (
  SELECT *, lag(home_goals, 1, 0) OVER w AS wh, lag(away_goals, 1, 0) OVER w AS wa, lag(regime, 1, 'NORMAL') OVER w AS wr, lag(momentum, 1, 0.5) OVER w AS wm, CASE WHEN momentum >= 0.5 THEN 'HOME' ELSE 'AWAY' END AS side
  FROM told WINDOW w AS (PARTITION BY match_id ORDER BY arrived, event_id))"""


@query("t05_observation_beats", OBSERVED + """ SELECT match_id, event_id AS seq, R(clock) AS minute, regime, R(momentum) AS momentum,
    CASE WHEN home_goals <> wh OR away_goals <> wa THEN 'goal ' || CASE WHEN home_goals <> wh THEN 'HOME' ELSE 'AWAY' END WHEN regime <> wr THEN 'regime shift'
      WHEN (wm - 0.5) * (momentum - 0.5) < 0 AND abs(momentum - 0.5) > 0.2 THEN 'momentum swing' END AS headline,
    CASE WHEN home_goals <> wh OR away_goals <> wa THEN home_goals || '-' || away_goals WHEN regime <> wr THEN regime || ' ' || side
      WHEN (wm - 0.5) * (momentum - 0.5) < 0 AND abs(momentum - 0.5) > 0.2 THEN side END AS detail FROM steps""", EV)
def t05_observations(spark, d):
    """The reading after each observation, in order of arrival, and the beat that it caused; the first against 0-0."""
    return live.logged(spark, _followed(spark, d), "panel").select("match_id", "seq", "minute", "regime", "momentum", "headline", "detail")


@query("t04_late_in_stream", ARRIVED + """ SELECT event_id AS seq, (minute < coalesce(max(minute) OVER (PARTITION BY match_id ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 6)::BIGINT AS late FROM arrivals""", EV)
def t04_stream(spark, d):
    """Every event once: on time, or handed on as late by the state of its match, which it does not change."""
    folder = _followed(spark, d, lateness=6.0)
    return live.logged(spark, folder, "panel").unionByName(live.logged(spark, folder, "late")).select("seq", (F.col("kind") == "late").alias("late"))


def _polls(spark, d, polls: int = 3):
    """Lands poll after poll and yields their folder: each repeats everything so far; players are filled in from the second on."""
    ev = match_events(spark, d).where("type IN ('goal', 'yellow_card', 'red_card')").withColumn("minute", F.floor("minute").cast("double"))
    path = new_folder(spark, "polls")
    for p in range(polls):
        seen = ev.where(F.col("minute") < (p + 1) * 95.0 / polls + 1)
        seen.select("match_id", "minute", "type", "team", F.when(F.lit(p) > 0, F.col("player_id")).alias("player_id"), F.lit(p).alias("poll")).write.mode("append").parquet(path)
        yield path


@query("t02_polled_observations", """ SELECT match_id, floor(minute)::DOUBLE AS minute, type, team, player_id, count(*) AS n FROM match_events WHERE type IN ('goal', 'yellow_card', 'red_card') GROUP BY ALL""", EV)
def t02(spark, d):
    schema = "match_id string, minute double, type string, team string, player_id string, poll int"
    folder = new_folder(spark, "feed")
    for path in _polls(spark, d):
        log = live.feed_polls(spark, live.read_files(spark, path, schema), folder)
    return log.groupBy("match_id", "minute", "type", "team", "player_id").agg(F.count("*").alias("n"))


def _snapshots(spark, d, polls: int = 3):
    """Lands a poll of every match after the other as provider snapshots and yields their folder: scorers unknown in the first, half of the matches finished in the last."""
    ev = match_events(spark, d).where("type IN ('goal', 'yellow_card', 'red_card', 'foul')")
    path = new_folder(spark, "snapshots")
    minute, no = F.floor("minute").cast("int").alias("minute"), F.col("match_no")
    for p in range(polls):
        side = F.struct((no * 2 + F.when(F.col("team") == "HOME", 0).otherwise(1)).alias("id")).alias("team")
        who = F.struct(F.when(F.lit(p) > 0, F.col("k")).cast("bigint").alias("id"))
        of = lambda kinds, *more: F.collect_list(F.when(F.col("type").isin(*kinds), F.struct(minute, side, *more)))
        card = F.when(F.col("type") == "yellow_card", "YELLOW").otherwise("RED").alias("card")
        seen = ev.where(F.col("minute") < (p + 1) * 95.0 / polls + 1).groupBy("match_no").agg(
            of(["goal"], who.alias("scorer")).alias("goals"), of(["yellow_card", "red_card"], who.alias("player"), card).alias("bookings"), of(["foul"], who.alias("playerIn")).alias("substitutions"))
        status = F.when(F.lit(p == polls - 1) & (F.pmod(no, F.lit(2)) == 0), "FINISHED").otherwise("IN_PLAY")
        doc = F.struct(no.alias("id"), status.alias("status"), F.struct((no * 2).alias("id")).alias("homeTeam"), F.struct((no * 2 + 1).alias("id")).alias("awayTeam"), "goals", "bookings", "substitutions")
        seen.select(F.to_json(doc)).write.text(f"{path}/poll={p:06d}")
        yield path


@query("s21_t02_snapshot_feed", """ SELECT match_no::VARCHAR AS match_id, floor(minute)::DOUBLE AS minute, CASE WHEN type = 'foul' THEN 'substitution' ELSE type END AS type, team, k::VARCHAR AS player_id, count(*) AS n
  FROM match_events WHERE type IN ('goal', 'yellow_card', 'red_card', 'foul') GROUP BY ALL""", EV)
def s21_feed(spark, d):
    """Polled snapshots through the streaming source, goals, cards and substitutions logged once; every poll is a restart from the last offset."""
    folder = new_folder(spark, "snapshot-feed")
    for path in _snapshots(spark, d):
        polls = feed.reports(feed.read_snapshots(spark, path, stream=True), F.regexp_extract("file", "poll=([0-9]+)", 1))
        log = live.feed_polls(spark, polls, folder)
    return log.groupBy("match_id", "minute", "type", "team", "player_id").agg(F.count("*").alias("n"))


@query("t04_late_rows", """ SELECT late::BIGINT AS late, count(*) AS n FROM (SELECT ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS late FROM events) GROUP BY 1""")
def t04(spark, d):
    from pitchgrid.bindings.tables import load
    ev = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = ev.agg(F.max("ts").alias("newest"))
    on_time, late = live.split_late(ev.join(F.broadcast(newest)), F.col("ts"), F.col("newest"), 7 * 86400)
    return on_time.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1))).groupBy("late").agg(F.count("*").alias("n"))


@query("k07_last_log_lines", """ SELECT match_id, event_id FROM match_events WHERE type IN ('goal', 'yellow_card', 'red_card') QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY event_id DESC) <= 8""", EV)
def k07(spark, d):
    log = match_events(spark, d).where("type IN ('goal', 'yellow_card', 'red_card')").withColumn("seq", F.col("event_id"))
    return live.last_lines(log).select("match_id", "event_id")


def _event_stream(spark, d):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    s = live.read_table(spark, f"{d}/events.parquet", schema)
    return s.select(F.timestamp_micros(naive_micros(F.col("ts"))).alias("ts"), "event_type", "user_id")


def _to_the_end(spark, counts, events):
    """All windows of the events that there are: an end marker closes those still open."""
    return live.run_to_end(spark, events, counts, new_folder(spark, "windows"))


@query("t08_tumbling_counts", """ SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s FROM events) GROUP BY ALL""")
def t08(spark, d):
    out = _to_the_end(spark, lambda e: live.windowed_counts(e, "6 hours"), _event_stream(spark, d))
    return out.select("event_type", F.substring(naive_text(F.col("w.start")), 1, 19).alias("start"), "n")


@query("t08_sliding_counts", """ SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - o * INTERVAL 6 HOUR AS s FROM events, unnest([0, 1]) u(o)) GROUP BY ALL""")
def t08_sliding(spark, d):
    out = _to_the_end(spark, lambda e: live.windowed_counts(e, "12 hours", "6 hours"), _event_stream(spark, d))
    return out.select("event_type", F.substring(naive_text(F.col("w.start")), 1, 19).alias("start"), "n")


@query("t08_session_counts", """ SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
  GROUP BY user_id, s""")
def t08_sessions(spark, d):
    out = _to_the_end(spark, lambda e: live.session_counts(e, "6 hours"), _event_stream(spark, d))
    return out.select("user_id", F.substring(naive_text(F.col("w.start")), 1, 19).alias("start"), "n")
