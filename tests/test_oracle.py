"""Registered queries against the SQL engine on the given tables.

ORACLE_ALL=1 runs every query; by default a spread of them, one per area.
"""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
DEFAULT = (
    "m15_panel", "m01_snapshots", "m05_walk_forward_report", "m09_other_targets", "x01_fused_fields", "x03_refuse_flips", "u01_aligned_timeline",
    "w20_timeline", "j09_w22_state_as_of", "n03_j19_integrity_violations", "a28_n08_graph_edges", "a02_player_counters", "a11_network_payload",
    "a12_j08_on_off", "w16_scout_ranking", "v06_j14_all_nearest_blocked", "w13_match_story", "w29_what_if_series", "s14_event_digest",
    "m11_outcome_projection", "m14_j15_decisions", "w09_tactical_geometry", "w18_position_estimates", "w25_attack_defence", "w26_elo",
    "a34_running_credibility", "s01_normalized_events", "s08_rejected_rows", "t01_t06_streamed_panels", "t08_session_counts",
)
NAMES = sorted(oracle_sql()) if os.environ.get("ORACLE_ALL") else DEFAULT


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def sql():
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_text_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(DEFAULT) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    cur = sql.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = [tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
