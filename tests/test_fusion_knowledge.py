import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import text as X
from pitchgrid.plans import fusion as U
from pitchgrid.plans import knowledge as K

D = dt.date(2024, 1, 1)


def test_entity_keys(spark):
    names = ["Arsenal FC", "1. FC Köln", "Real-Madrid C.F.", "  Ath  Madrid ", "Schalke 04", "Brighton & Hove", None, "Čáslav"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.k for r in df.select(X.entity_key(F.col("n")).alias("k")).collect()]
    assert got == ["arsenal", "koln", "real madrid c f", "ath madrid", "schalke", "brighton hove", "", "caslav"]
    letters = spark.createDataFrame([("".join(chr(c) for c in range(0xC0, 0x250)),)], "n string")
    both = letters.select(X.fold_accents(F.col("n")).alias("a"), X.fold_accents_exact(F.col("n")).alias("b")).first()
    differs = {x for x, y in zip(both.a, both.b) if x != y}
    assert len(both.a) != len(both.b) or not differs                   # only multi-letter foldings differ


def test_player_ids_use_the_strongest_evidence(spark):
    df = spark.createDataFrame([("José A", "1990-01-01", "Q1"), ("Jose A", "1990-01-01", None), ("JOSE A.", "1990-01-01", None), ("Jose A", None, None)], "n string, b string, q string")
    ids = [r.i for r in df.select(X.player_id(F.col("n"), F.col("b"), F.col("q")).alias("i")).collect()]
    assert ids[1] == ids[2] and len(set(ids)) == 3


def _cells(spark, rows, priors=None, tolerance=None):
    schema = "source string, seq int, date date, home string, away string, goals double"
    df = spark.createDataFrame([(s, i, D, "A", "B", v) for i, (s, v) in enumerate(rows)], schema)
    return U.fuse(U.resolve(df), priors, tolerance, ("goals",)).first()


def test_votes(spark):
    c = _cells(spark, [("a", 2.0), ("b", 1.0)], {"a": 0.6, "b": 0.9})
    assert c.value == 1.0 and c.confidence == pytest.approx(0.6) and not c.agreed and c.dissent == {"a": 2.0}
    c = _cells(spark, [("a", 2.0), ("b", 1.0), ("c", 2.0)])
    assert c.value == 2.0 and c.sources == ["a", "c"] and c.confidence == pytest.approx(2 / 3)
    c = _cells(spark, [("a", 2.0), ("b", 1.0)])                         # full tie: last source list
    assert c.value == 1.0
    c = _cells(spark, [("a", None), ("b", 3.0)])
    assert c.value == 3.0 and c.agreed and c.confidence == 1.0 and c.n_claims == 1
    c = _cells(spark, [("a", None)])
    assert c.value is None and c.confidence == 0.0 and c.sources == []
    c = _cells(spark, [("a", 5.0), ("a", 7.0)])                         # a later duplicate replaces
    assert c.value == 7.0 and c.n_claims == 1


def test_first_fit_clusters_with_tolerance(spark):
    # b joins a (1 apart), c is 2 from a's reference and opens its own cluster
    c = _cells(spark, [("a", 10.0), ("b", 11.0), ("c", 12.0)], None, {"goals": 1.0})
    assert c.value == 10.5 and c.sources == ["a", "b"] and c.dissent == {"c": 12.0}
    for order in ([2, 0, 1], [1, 2, 0]):
        rows = [[("a", 10.0), ("b", 11.0), ("c", 12.0)][i] for i in order]
        assert _cells(spark, rows, None, {"goals": 1.0}).sources == ["a", "b"]


def _greedy(a, b, window=5.0):
    """Straightforward one-to-one pairing, for comparison."""
    used, diffs = set(), []
    for tb in sorted(b):
        free = [(abs(tb - ta), i) for i, ta in enumerate(sorted(a)) if i not in used]
        if free and min(free)[0] <= window:
            i = min(free)[1]
            used.add(i)
            diffs.append(tb - sorted(a)[i])
    diffs.sort()
    m = len(diffs) // 2
    return 0.0 if not diffs else diffs[m] if len(diffs) % 2 else (diffs[m - 1] + diffs[m]) / 2


@pytest.mark.parametrize("a,b", [
    ([10, 30, 70], [11, 31, 71]), ([10, 10, 12], [10.5, 10.5, 10.5]), ([10], []), ([5, 6, 50], [9, 9, 90]), ([20, 22], [21, 21, 21, 21])])
def test_clock_offsets_match_pairwise_greedy(spark, a, b):
    rows = [("m", "a", float(m), "goal") for m in a] + [("m", "b", float(m), "goal") for m in b] + [("m", "b", 1.0, "foul")]
    df = spark.createDataFrame(rows, "match_id string, source string, minute double, type string")
    got = {r.source: r.offset for r in U.clock_offsets(df).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(round(_greedy(a, b), 3))


def _paired(a, b, window=5.0):
    pairing, shifts = U.Pairing(window), []
    for minute, side in sorted([(m, 0) for m in a] + [(m, 1) for m in b]):
        shifts += [d for d, n in pairing.decided(minute) for _ in range(n)]
        (pairing.anchor if side else pairing.reference)(minute, 1)
    return shifts + [d for d, n in pairing.decided(math.inf) for _ in range(n)], pairing


def test_pairing_along_the_clock_is_the_greedy_one():
    rnd = random.Random(4)
    for _ in range(2000):
        a, b = ([rnd.choice([rnd.randint(0, 40), rnd.random() * 40]) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        window = rnd.choice([0.5, 2.0, 5.0])
        shifts = sorted(_paired(a, b, window)[0])
        m = len(shifts) // 2
        got = 0.0 if not shifts else shifts[m] if len(shifts) % 2 else (shifts[m - 1] + shifts[m]) / 2
        assert got == pytest.approx(_greedy(a, b, window)), (a, b, window)


def test_a_match_with_a_million_anchors(spark):
    """Half a million readings a source, out of step by 0.011 minutes: linear work, and a task holds a window of them."""
    n = 500_000
    base = spark.range(n).select(F.lit("m").alias("match_id"), (F.col("id") * 0.01).alias("minute"), F.lit("goal").alias("type"))
    both = base.withColumn("source", F.lit("a")).unionByName(base.withColumn("minute", F.col("minute") + 0.001).withColumn("source", F.lit("b")))
    got = {r.source: r.offset for r in U.clock_offsets(both).collect()}
    assert got == {"a": 0.0, "b": 0.001}
    pairing, most = U.Pairing(5.0), 0
    for i in range(20_000):
        for _ in pairing.decided(i * 0.01):
            pass
        pairing.reference(i * 0.01, 1)
        pairing.anchor(i * 0.01, 1)
        most = max(most, len(pairing.behind) + len(pairing.ahead) + len(pairing.waiting))
    assert most < 2000


def test_offsets_without_anchors_and_medians_of_many_values(spark):
    rows = [("m", "a", 3.0, "foul"), ("m", "b", 4.0, "goal"), ("m", "c", None, "goal"), ("n", "a", 10.0, "goal"), ("n", "c", 12.5, "goal"), ("n", "c", 30.0, "goal")]
    df = spark.createDataFrame(rows, "match_id string, source string, minute double, type string")
    assert {(r.match_id, r.source): r.offset for r in U.clock_offsets(df).collect()} == {("m", "a"): 0.0, ("m", "b"): 0.0, ("m", "c"): 0.0, ("n", "a"): 0.0, ("n", "c"): 2.5}
    values = [(k, random.Random(k + i).uniform(-5, 5), i % 3 + 1) for k in range(3) for i in range(20 + k)]
    got = U.weighted_median(spark.createDataFrame(values, "k int, v double, n long"), ["k"], "v", "n", "median", F.floor(F.col("v") * 16)).collect()
    assert {r.k: pytest.approx(r.median) for r in got} == {k: statistics.median([v for kk, v, n in values if kk == k for _ in range(n)]) for k in range(3)}


VERSION = "seq long, id string, kind string, entity string, value string, layer string, source string, collected_at date, valid_from date, valid_to date, permanence string, confidence double"


def _versions(spark, rows):
    def day(n):
        return None if n is None else D + dt.timedelta(days=n)
    return spark.createDataFrame([
        (i, f"v{i}", "role", "p", r[0], r[5] if len(r) > 5 else "observed", "s", day(r[4] if len(r) > 4 else 0), day(r[1]), day(r[2]), r[3], 0.5)
        for i, r in enumerate(rows)], VERSION)


def test_permanent_versions_close_each_other(spark):
    t = {r.id: r for r in K.build_timeline(_versions(spark, [("a", 0, None, "permanent"), ("tmp", 5, 8, "temporary"), ("b", 10, None, "permanent"), ("c", 20, 25, "permanent")])).collect()}
    assert t["v0"].valid_to == D + dt.timedelta(10) and t["v0"].superseded_by == "v2"
    assert t["v2"].valid_to == D + dt.timedelta(20) and t["v2"].superseded_by == "v3"
    assert t["v3"].valid_to == D + dt.timedelta(25) and t["v3"].superseded_by is None and t["v1"].superseded_by is None


def test_as_of_reads_half_open_windows_and_overrides(spark):
    timeline = K.build_timeline(_versions(spark, [("a", 0, None, "permanent"), ("tmp", 5, 8, "temporary"), ("b", 10, None, "permanent")]))
    at = lambda n: D + dt.timedelta(n)
    got = {r.at: r.value for r in K.state_as_of(timeline, [at(n) for n in (-1, 0, 5, 7, 8, 9, 10)]).collect()}
    assert got == {at(0): "a", at(5): "tmp", at(7): "tmp", at(8): "a", at(9): "a", at(10): "b"}
    assert K.current_state(timeline).first().value == "b"


def test_state_skips_what_was_collected_later_or_simulated(spark):
    timeline = _versions(spark, [("a", 0, None, "temporary", 0), ("b", 1, None, "temporary", 9), ("c", 2, None, "temporary", 0, "simulated")]).withColumn("superseded_by", F.lit(None).cast("string"))
    got = K.assemble_state(timeline, [D + dt.timedelta(5), D + dt.timedelta(9)]).collect()
    assert {r.at.day: r.value for r in got} == {6: "a", 10: "b"}
    reasons = {r.id: r.reason for r in K.future_leaks(timeline, F.lit(D + dt.timedelta(5))).collect()}
    assert reasons == {"v1": "collected later", "v2": "layer not allowed"}


def test_gate_and_store(spark):
    sim = spark.createDataFrame([("x", "simulated", ["run"])], "id string, layer string, transformations array<string>")
    with pytest.raises(PermissionError):
        K.gate(sim, audited=False)
    assert K.gate(sim, audited=True).first().transformations == ["run", "audit:passed"]
    with pytest.raises(Exception):
        K.gate(sim.withColumn("layer", F.lit("observed")), audited=True).collect()
    once = K.store(sim, sim)
    assert once.count() == 1 and K.store(once, sim).count() == 1


def test_integrity_rules(spark):
    schema = "id string, layer string, source string, parent string, pipeline_version string, minute double, match_id string, player_id string, team string"
    rows = [("ok", "observed", "s", None, None, 5.0, "m", "p", "T1"), ("noprov", "observed", "", None, None, None, "m", None, None),
            ("noev", "derived", "s", None, None, None, None, None, None), ("nomatch", "observed", "s", None, None, 3.0, None, None, None),
            ("two", "observed", "s", None, None, None, "m", "p", "T2"), ("cited", "derived", "s", "ok", None, None, None, None, None)]
    bad = K.integrity(spark.createDataFrame(rows, schema), spark.createDataFrame([("q",)], "player_id string"))
    assert {(r.rule, r.key) for r in bad.collect()} == {
        ("no provenance", "noprov"), ("no evidence", "noev"), ("event without match", "nomatch"), ("player on two teams", "m/p"), ("unknown player", "ok"), ("unknown player", "two")}
    with pytest.raises(ValueError):
        K.enforce(bad)
    K.enforce(bad.limit(0))


def test_edges_widen_validity(spark):
    schema = "player_id string, team string, match_id string, competition string, source string, valid_from date, valid_to date"
    rows = [("p", "T", None, None, "a", D, None), ("p", "T", None, None, "b", None, D), ("p", "T", None, None, "a", D, D)]
    e = K.graph_edges(spark.createDataFrame(rows, schema)).first()
    assert (e.src, e.relation, e.dst, e.n, e.sources, e.valid_from, e.valid_to) == ("player:p", "played_for", "team:T", 3, ["a", "b"], None, None)


def test_sharing_denies_by_default_and_on_bad_policies(spark):
    df = spark.createDataFrame([("k", "observed", "a"), ("k2", "observed", "locked"), ("k2", "derived", "a")], "kind string, layer string, source string")
    policy = {"by_layer": {"observed": "syncable"}, "by_kind": {"k2": "syncable"}, "local_sources": ["locked"]}
    assert [r.sharing for r in K.classify_sharing(df, policy).collect()] == ["syncable", "local_only", "syncable"]
    for broken in (None, {"default": "everyone"}, "nonsense"):
        assert {r.sharing for r in K.classify_sharing(df, broken).collect()} == {"local_only"}


def test_consensus_ties_and_zero_weight(spark):
    df = spark.createDataFrame([("a", "y", 1.0), ("a", "x", 1.0), ("b", "z", 0.0)], "k string, claim string, weight double")
    got = {r.k: (r.claim, r.agreement) for r in U.consensus(df, ["k"]).collect()}
    assert got == {"a": ("x", 0.5), "b": (None, 0.0)}


def test_lifted_values_keep_type_context_and_identity(spark):
    panels = spark.createDataFrame([("m", 10, 0.1, 0.2, None, 0.75, 0.9)], "match_id string, minute int, goal_next_5min double, goal_next_10min double, goal_before_half double, next_goal_home double, confidence double")
    vectors = spark.createDataFrame([("m", [0.5, None, 1.0])], "match_id string, vec array<double>")
    behaviours = spark.createDataFrame([("m", "HOME", "p", 0.4, None, 0.9, 0.3, 0.8, {"leadership": "no_conduct_signals"})],
                                       "match_id string, team string, player_id string, decision_stability double, pressure_resistance double, aggression_control double, resilience double, confidence double, reasons map<string,string>")
    strengths = spark.createDataFrame([("C", 2.5)], "competition string, goals_per_match double")
    records = K.lift_outputs(panels=panels, vectors=vectors, behaviours=behaviours, strengths=strengths)
    assert dict(records.dtypes)["value"] == "variant"
    assert sorted(r.kind for r in records.select("kind").collect()) == [
        "behavioral_profile", "competition_strength", "match_vector", "pred_goal_next_10min", "pred_goal_next_5min", "pred_next_goal"]  # a null prediction is none
    one = lambda kind: K.typed_values(records, kind).first()
    assert (one("pred_next_goal").value.home, one("pred_next_goal").value.away) == (0.75, 0.25) and one("pred_goal_next_5min").minute == 10.0
    assert one("pred_next_goal").confidence == 0.9 and one("pred_next_goal").layer == "probabilistic" and one("match_vector").value == [0.5, None, 1.0]
    b = one("behavioral_profile")
    assert (b.value.pressure_resistance, b.value.reasons, b.team, b.player_id) == (None, {"leadership": "no_conduct_signals"}, "HOME", "p")
    assert one("competition_strength").value == 2.5 and one("competition_strength").competition == "C"
    ids = lambda r: sorted(x.id for x in r.select("id").collect())
    assert ids(records) == ids(K.lift_outputs(strengths=strengths, panels=panels, behaviours=behaviours, vectors=vectors)) and len(set(ids(records))) == 6


def test_flips_of_two_votes_in_one_row_equal_the_join_of_two_fusions(spark):
    """Disputes, agreement, claims of one provider, nulls, ties, tolerance and unknown sources; nothing but disputes is voted on twice."""
    rnd = random.Random(8)
    rows = [(s, i, D if i % 40 > 3 else None, f"h{i % 40}", f"a{i % 40}", rnd.choice([None, 0, 1, 1, 2, 7])) for i in range(160) for s in ("a", "b", "c", "d") if rnd.random() < 0.8]
    records = U.resolve(spark.createDataFrame(rows, "source string, seq long, date date, home string, away string, goals int"))
    first, again = {"a": 0.9, "b": 0.5, "c": 0.95}, spark.createDataFrame([("a", 0.2), ("b", 0.99), ("c", 0.2), ("e", 1.0)], "source string, rate double")
    for tolerance in (None, {"goals": 1.0}):
        want = U.flips(U.fuse(records, first, tolerance, ("goals",)), U.fuse(records, again, tolerance, ("goals",)))
        got = U.refuse_flips(records, first, again, tolerance, ("goals",))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
        assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString() and got.where("date IS NULL").isEmpty()


def test_votes_are_folded_only_for_cells_in_dispute(spark):
    """Agreed and empty cells have the outcome of the fold without it."""
    claim = "array<struct<source:string,value:double,prior:double>>"
    cells = spark.createDataFrame([([],), ([("a", 2.0, 0.5)],), ([("a", 1.0, 0.5), ("b", 1.0, 0.0)],), ([("a", 1.0, 0.0)],), ([("a", 1.0, 0.5), ("b", 3.0, 0.5), ("c", 3.0, 0.25)],)], f"claims {claim}")
    got = [tuple(r.v) for r in cells.select(U.vote(F.col("claims"), F.lit(0.0)).alias("v")).collect()]
    assert got == [(None, 0.0, False, [], {}), (2.0, 1.0, True, ["a"], {}), (1.0, 1.0, True, ["a", "b"], {}), (1.0, 0.0, True, ["a"], {}),
                   (3.0, 0.6, False, ["b", "c"], {"a": 1.0})]


def test_lifted_records_are_stored_without_a_sort(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from pitchgrid.bindings import q_knowledge
    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet

    def parquet(self, path, **options):
        seen.append(int(spark.conf.get(name)))
        return write(self, path, **options)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    was = spark.conf.get(name, None)
    rows = spark.createDataFrame([(k, i) for i in range(50) for k in K.LIFTED], "kind string, i int")
    got = q_knowledge.stored_records(rows)
    assert min(seen) >= len(K.LIFTED) and spark.conf.get(name, None) == was     # one writer a time after a sort before
    assert sorted(map(tuple, got.select("kind", "i").collect())) == sorted(map(tuple, rows.collect()))
