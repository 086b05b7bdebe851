import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT = "match_id string, event_id long, minute double, team string, type string, player_id string, x double, y double"


@pytest.fixture
def events(spark):
    """Build an event table from (match, minute, team, type[, x, y]) tuples."""
    def build(rows):
        full = [(r[0], i, float(r[1]), r[2], r[3], f"p{i % 5}", float(r[4]) if len(r) > 4 else None, float(r[5]) if len(r) > 5 else None)
                for i, r in enumerate(rows)]
        return spark.createDataFrame(full, EVENT)
    return build
