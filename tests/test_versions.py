"""Match replacement, killed writes and stale derivations."""

import pytest
from pyspark.sql import functions as F

from pitchgrid.sources import versions

SCHEMA = "competition string, match_id string, v int"


def content(spark, path, version=None):
    return sorted(((r.competition, r.match_id, r.v) for r in versions.read(spark, path, ["competition"], version).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_match_is_replaced_and_all_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(c, f"{c}{i}", k) for c in ("01", "1e5", None) for i in range(6) for k in range(2)]
    assert versions.replace_matches(frame(spark, rows), path, ["competition"], buckets=2) == 0
    assert content(spark, path) == sorted(rows, key=str)
    before = {(r.competition, r.match_bucket): r.folder for r in versions.parts(spark, path).collect()}
    for _ in range(2):
        versions.replace_matches(frame(spark, [("01", "013", 9)]), path, ["competition"], buckets=2)
    want = [r for r in rows if r[1] != "013"] + [("01", "013", 9)]
    assert content(spark, path) == sorted(want, key=str)
    after = {(r.competition, r.match_bucket): r.folder for r in versions.parts(spark, path).collect()}
    assert sum(before[k] != after[k] for k in before) == 1               # only the match's own part was written
    versions.replace_matches(frame(spark, [("new", "013", 7)]), path, ["competition"], buckets=2)
    want = [r for r in rows if r[1] != "013"] + [("new", "013", 7)]       # it left its old competition
    assert content(spark, path) == sorted(want, key=str)
    assert content(spark, path, 0) == sorted(rows, key=str)


def test_a_killed_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [("a", f"m{i}", i) for i in range(8)]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, ["competition"])
    versions.replace_matches(frame(spark, rows), path, ["competition"], buckets=4)
    with monkeypatch.context() as m:                                      # data files are written, the version is not
        m.setattr(type(frame(spark, rows)), "coalesce", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            versions.replace_matches(frame(spark, [("a", "m3", 99)]), path, ["competition"], buckets=4)
    assert content(spark, path) == sorted(rows)
    (tmp_path / "t" / "versions" / "v=000000001").mkdir()                 # a version without its mark is not one
    assert content(spark, path) == sorted(rows)
    assert versions.replace_matches(frame(spark, [("a", "m3", 99)]), path, ["competition"], buckets=4) == 2
    assert ("a", "m3", 99) in content(spark, path)


def test_changed_inputs_and_code_make_matches_stale(spark):
    rows = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1), ("o", 5)], "match_id string, v int")
    marks = lambda df, code: versions.fingerprints(df, [F.col("v")], code)
    derived = marks(rows.where("match_id <> 'o'"), "v1")
    stale = lambda now, **k: sorted(r.match_id for r in versions.stale(now, derived, **k).collect())
    assert stale(marks(rows, "v1")) == ["o"]
    assert stale(marks(rows.withColumn("v", F.when(F.col("match_id") == "n", 3).otherwise(F.col("v"))), "v1")) == ["n", "o"]
    assert stale(marks(rows, "v2")) == ["m", "n", "o"] == stale(marks(rows, "v1"), rebuild=True)


def test_replacing_computes_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_matches(frame(spark, [("a", f"m{i}", i) for i in range(6)]), path, ["competition"], buckets=2)
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x
    new = frame(spark, [("a", "m1", 10), ("a", "m2", 20)]).withColumn("match_id", F.udf(same, "string")("match_id"))
    versions.replace_matches(new, path, ["competition"], buckets=2)
    assert seen.value == 2
    assert content(spark, path) == [("a", "m0", 0), ("a", "m1", 10), ("a", "m2", 20), ("a", "m3", 3), ("a", "m4", 4), ("a", "m5", 5)]
