"""Two-level ordered operators against plain Python."""

import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.operators import nearest as N
from pitchgrid.operators import ordered as O
from pitchgrid.operators.nearest import nearest


def _rows(spark, n=400, keys=3, seed=1):
    rnd = random.Random(seed)
    # one key holds most rows, some keys are null
    rows = [(rnd.choice(["hot"] * 8 + ["a", None][: keys - 1]), i, rnd.randint(0, 9)) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o long, v long")


def test_running_sums(spark):
    rows, df = _rows(spark)
    for inclusive in (True, False):
        got = {(r.k, r.o): r.s for r in O.running_sums(df, ["k"], F.floor(F.col("o") / 16), [F.col("o")], {"s": F.col("v")}, inclusive=inclusive).collect()}
        for k, o, v in rows:
            want = sum(x[2] for x in rows if x[0] == k and (x[1] <= o if inclusive else x[1] < o))
            assert got[(k, o)] == want


def test_neighbour_and_carried(spark):
    rows, df = _rows(spark)
    ordered = sorted(rows, key=lambda r: r[1])
    got = {r.o: (r.pv, r.po) for r in O.neighbour(df, ["k"], F.floor(F.col("o") / 7), ["o"], {"pv": "v", "po": "o"}).collect()}
    nxt = {r.o: r.nv for r in O.neighbour(df, ["k"], F.floor(F.col("o") / 7), ["o"], {"nv": "v"}, following=True).collect()}
    last = {}
    for k, o, v in ordered:
        assert got[o] == last.get(k, (None, None))
        last[k] = (v, o)
    last = {}
    for k, o, v in reversed(ordered):
        assert nxt[o] == last.get(k)
        last[k] = v
    sparse = df.withColumn("v", F.when(F.col("v") > 6, F.col("v")))
    seen, kept = {r.o: r.c for r in O.carried(sparse, ["k"], F.floor(F.col("o") / 9), ["o"], "v", "c").collect()}, {}
    for k, o, v in ordered:
        if v > 6:
            kept[k] = v
        assert seen[o] == kept.get(k)


def test_numbered_global_and_running_max(spark):
    rows, df = _rows(spark)
    got = O.numbered(df, [], F.floor("v"), [F.col("v"), F.col("o")], "rn", "n").collect()
    assert [(r.v, r.o) for r in sorted(got, key=lambda r: r.rn)] == sorted((r[2], r[1]) for r in rows)
    assert {r.n for r in got} == {len(rows)} and sorted(r.rn for r in got) == list(range(1, len(rows) + 1))
    top = {r.o: r.m for r in O.running_max(df, ["k"], F.floor(F.col("o") / 20), [F.col("o")], "v", "m").collect()}
    for k, o, v in rows:
        assert top[o] == max(x[2] for x in rows if x[0] == k and x[1] <= o)


def test_mid_rank(spark):
    values = [0.1, 0.1, 0.5, 0.9, 0.9, 0.9]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "c string, i int, v double")
    got = {r.i: r.p for r in O.mid_rank(df, ["c"], "v", "p").collect()}
    for i, v in enumerate(values):
        want = (sum(x < v for x in values) + 0.5 * sum(x == v for x in values)) / len(values)
        assert abs(got[i] - want) < 1e-12


def test_top_k_limits_before_the_shuffle(spark):
    rows, df = _rows(spark)
    top = O.top_k(df, ["k"], [F.col("v").desc(), F.col("o")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for k in {r[0] for r in rows}:
        want = sorted((-r[2], r[1]) for r in rows if r[0] == k)[:3]
        assert [(-r.v, r.o) for r in sorted(top.where(F.col("k").eqNullSafe(k)).collect(), key=lambda r: r.rank)] == want


def test_multiset_new_keeps_a_brace(spark):
    stored = spark.createDataFrame([("m", "goal")], "m string, t string")
    incoming = spark.createDataFrame([("m", "goal", 1), ("m", "goal", 2), ("m", "red", 3)], "m string, t string, s int")
    new = O.multiset_new(incoming, stored, ["m", "t"], [F.col("s")], F.lit(0))
    assert sorted((r.t, r.s) for r in new.collect()) == [("goal", 2), ("red", 3)]


def test_digest_ignores_order_and_partitions(spark):
    rows = [("m", i, f"t{i % 3}") for i in range(50)]
    a = spark.createDataFrame(rows, "m string, i int, t string")
    b = spark.createDataFrame(rows[::-1], "m string, i int, t string").repartition(7)
    cols = [F.col("i"), F.col("t")]
    one, two = (O.multiset_digest(x, ["m"], cols).first().digest for x in (a, b))
    changed = O.multiset_digest(a.where("i <> 3"), ["m"], cols).first().digest
    assert one == two != changed


def test_nearest_paths_agree_with_brute_force(spark):
    rnd = random.Random(3)
    vecs = {f"v{i}": [rnd.random() - 0.5 for _ in range(4)] for i in range(60)}
    vecs["v60"] = vecs["v1"]
    df = spark.createDataFrame([(k, v) for k, v in vecs.items()], "id string, vec array<double>")

    def cos(u, v):
        dot = sum(a * b for a, b in zip(u, v))
        return dot / (sum(a * a for a in u) ** 0.5 * sum(b * b for b in v) ** 0.5)
    want = {(t, r): c for t in vecs for r, c in enumerate(
        [c for c, _ in sorted(((c, -round(cos(vecs[t], vecs[c]), 12)) for c in vecs if c != t), key=lambda x: (x[1], x[0]))[:4]], 1)}
    for opts in ({}, {"block": 10, "slice_rows": 17}):
        got = {(r.target, r.rank): r.candidate for r in nearest(df, df, 4, **opts).collect()}
        assert got == want


def test_pruned_search_visits_few_cells_and_loses_nothing(spark):
    """Clustered vectors, ties, zero and null vectors: brute force agrees, and most cells are never looked at."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6))
    rows = [(f"c{i:04d}", (centres[i % 20] + 0.05 * rng.normal(size=6)).tolist()) for i in range(1500)]
    rows += [("zero", [0.0] * 6), ("same1", rows[3][1]), ("same2", rows[3][1]), ("none", None), ("far", (-centres[0]).tolist())]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    got = {}
    for r in nearest(df, df, 4, block=100, slice_rows=50, pivots=40).collect():
        got.setdefault(r.target, {})[r.rank] = (r.candidate, r.similarity)
    known = [(i, np.array(v)) for i, v in rows if v is not None]
    ids = np.array([i for i, _ in known])
    unit = np.array([v / max(np.linalg.norm(v), 1e-300) for _, v in known])
    assert set(got) == set(ids)
    for t in [0, 3, 700, 1499, *range(1500, len(known))]:
        sims = unit @ unit[t]
        sims[t] = -9
        want = sorted(zip(-np.round(sims, 12), ids))[:4]
        assert [got[ids[t]][n + 1][0] for n in range(4)] == [i for _, i in want]
    placed, cells = N._cells(df, 40)
    targets = df.where("id like 'c%'")
    first = N.visits(targets, cells, 4)
    near = N._meet(first, placed, cells, 4, True, 1000, 1000)
    share = (first.count() + N.visits(targets, cells, 4, near).count()) / (targets.count() * (cells.counts > 0).sum())
    assert share < 0.3
    assert nearest(df.limit(0), df, 3).collect() == [] and nearest(df, df.limit(0), 3).collect() == []


def test_percentiles_of_a_value_that_most_rows_share_and_an_outlier(spark):
    """90 % of the rows hold one value, one value is far from all others, and cohorts may be null."""
    rnd = random.Random(5)
    rows = [("a" if i % 4 else None, 7.0 if rnd.random() < 0.9 else rnd.choice([1e12, rnd.random(), float(rnd.randint(0, 5))]), i) for i in range(4000)] + [("b", None, -1), ("b", 2.0, -2)]
    df = spark.createDataFrame(rows, "cohort string, v double, i long")
    got = {r.i: r.pct for r in O.mid_rank(df, ["cohort"], "v", "pct", slots=16).collect()}
    assert len(got) == len(rows) and got[-1] is None and got[-2] == 0.5
    for cohort in ("a", None):
        own = sorted(v for c, v, i in rows if c == cohort)
        for c, v, i in rows:
            if c == cohort:
                assert got[i] == pytest.approx((bisect_left(own, v) + 0.5 * (bisect_right(own, v) - bisect_left(own, v))) / len(own))
    plain = {r.i: r.pct for r in O.mid_rank(df.drop("cohort"), [], "v", "pct").collect()}
    assert plain[-1] is None and max(p for p in plain.values() if p) < 1


def test_slots_follow_distinct_values_not_the_range(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 0, 1e15).otherwise(F.col("id").cast("double")).alias("v"))
    plan = O.mid_rank(df, [], "v", "pct", slots=50)
    assert plan.count() == 5000 and plan.agg(F.max("pct")).first()[0] == pytest.approx(4999.5 / 5000)


def test_the_second_look_of_nearest_sends_only_what_can_win(spark, monkeypatch):
    """Cells looked at second give no rows below the k-th similarity, ties and copies included, however few similarities a task holds."""
    rng = np.random.default_rng(7)
    rows = [(f"r{i:04d}", rng.normal(size=8).round(1).tolist()) for i in range(800)] + [(f"copy{i}", [1.0] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    placed, cells = N._cells(df, 16)
    near = N.top_k(N._meet(N.visits(df, cells, 3), placed, cells, 3, True, 4000, 20000), ["target"], [F.round("similarity", 12).desc(), F.col("candidate")], 3).drop("rank")
    second = N.visits(df, cells, 3, near)
    assert N._meet(second, placed, cells, 3, True, 4000, 20000).count() < second.count()   # 3 a visit before
    ids, unit = [r[0] for r in rows], N._unit([r[1] for r in rows])
    whole = N._block_best(ids, unit, ids, unit, 3, True)
    monkeypatch.setattr(N, "SIMS", 1000)
    small = N._block_best(ids, unit, ids, unit, 3, True, np.full(len(ids), -1.0))
    assert whole[["target", "candidate"]].equals(small[["target", "candidate"]]) and len(whole) == 3 * len(rows)
    assert whole[whole.target == "copy0"].candidate.tolist() == ["copy1", "copy10", "copy11"]


def test_frames_of_nearest_do_not_grow_with_cells(spark, monkeypatch):
    """No task hands on a frame of targets times cells: vectors that no cell tells apart made one of 2,500 x 64 rows before."""
    rng = np.random.default_rng(11)
    rows = [(f"n{i:04d}", v) for i, v in enumerate(rng.normal(size=(2500, 24)).tolist())]
    df = spark.createDataFrame(rows, "id string, vec array<double>").coalesce(1)
    kind, plain = type(df), type(df).mapInPandas

    def bounded(self, f, schema, *args):
        def spy(frames):
            for out in f(frames):
                assert len(out) <= 10_000, len(out)
                yield out
        return plain(self, spy, schema, *args)

    monkeypatch.setattr(kind, "mapInPandas", bounded)
    got = {}
    for r in nearest(df, df, 3).collect():
        got.setdefault(r.target, {})[r.rank] = r.candidate
    ids, unit = [r[0] for r in rows], N._unit([r[1] for r in rows])
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    for t in range(0, 2500, 50):
        assert [got[ids[t]][n] for n in (1, 2, 3)] == [ids[c] for c in np.lexsort((ids, -np.round(sims[t], 12)))[:3]]
    assert len(got) == 2500


@pytest.mark.parametrize("few", [0, 64])
def test_similarities_too_close_for_single_precision(monkeypatch, few):
    """Vectors that differ by a billionth are ranked in double precision, however many reach the k-th similarity."""
    monkeypatch.setattr(N, "FEW", few)
    rng = np.random.default_rng(4)
    vecs = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=16) + 1e-9 * rng.normal(size=(200, 16)), np.zeros((2, 16))])
    ids, unit = [f"v{i:03d}" for i in range(len(vecs))], N._unit(vecs)
    got = N._block_best(ids, unit, ids, unit, 3, True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    want = np.sort(np.round(sims, 12), axis=1)[:, :-4:-1]
    assert np.allclose(got["similarity"].to_numpy().reshape(-1, 3), want, rtol=0, atol=2e-12)
    known = N._block_best(ids, unit, ids, unit, 3, True, want[:, 2])
    assert known[["target", "candidate"]].equals(got[["target", "candidate"]])


def test_nearest_of_ids_that_repeat_or_are_null_and_vectors_without_a_cosine(spark):
    """Rows of one id share its k places, an id is not its own neighbour, null ids are one id, and vectors with nulls or NaN take no part."""
    rng = np.random.default_rng(9)
    rows = [(f"d{i % 40:02d}", rng.normal(size=5).tolist()) for i in range(120)] + [(None, rng.normal(size=5).tolist()) for _ in range(3)]
    odd = [("nan", [float("nan")] + [1.0] * 4), ("gap", [None] + [1.0] * 4), ("inf", [float("inf")] + [1.0] * 4), ("none", None)]
    df = spark.createDataFrame(rows + odd, "id string, vec array<double>")
    got = {}
    for r in nearest(df, df, 4, block=20, slice_rows=50, pivots=8).collect():
        got.setdefault(r.target, {})[r.rank] = (r.candidate, round(r.similarity, 10))
    unit = N._unit([v for _, v in rows])
    sims = unit @ unit.T
    assert set(got) == {i for i, _ in rows}
    for t in got:
        own = [i for i, r in enumerate(rows) if r[0] == t]
        want = sorted(((-round(sims[i, c], 12), r[0] or "", round(sims[i, c], 10)) for i in own for c, r in enumerate(rows) if r[0] != t))[:4]
        assert [(got[t][n + 1][0] or "", got[t][n + 1][1]) for n in range(4)] == [w[1:] for w in want]
