"""Retention indices, clusters of overlapping peaks and the rest of ``operators/indices`` on hand-made cases; the sample tree against plain search."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraflow.functions import index
from spectraflow.operators import indices, sample_graph


def test_retention_index_between_before_at_and_behind_standards(spark):
    points = spark.createDataFrame([("a", t) for t in (5.0, 15.0, 20.0, 35.0, 40.0)] + [("none", 1.0)], "sample string, rtime double")
    ladder = spark.createDataFrame([("a", 10.0, 8), ("a", 20.0, 9), ("a", 30.0, 10)], "sample string, t double, n int")
    got = {r["rtime"]: r["ri"] for r in indices.retention_index(points, ladder, "sample", "rtime", "t", "n").collect()}
    assert got[5.0] is None and got[20.0] == math.inf and set(got) == {5.0, 15.0, 20.0, 35.0, 40.0}
    assert got[15.0] == pytest.approx(100 * (8 + 5 / 5)) and got[35.0] == pytest.approx(100 * (10 + 5 / 9)) and got[40.0] == pytest.approx(100 * (10 + 10 / 4))


def test_penalty_and_calibration(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (50.0,), (100.0,), (100.5,), (None,)], "d double")
    got = {r["d"]: r["p"] for r in rows.select("d", index.penalty(F.col("d")).alias("p")).collect()}
    curve = lambda d: 2 / (1 + math.exp(math.e * d / 100))
    assert got[0.5] == 1 and got[100.5] == 0 and got[None] is None
    assert all(got[d] == pytest.approx(curve(d)) for d in (1.0, 50.0, 100.0))
    assert [r[0] for r in spark.range(1).select(index.calibrated(F.lit(100.0), F.lit(3e-6)), index.calibrated(F.lit(100.0), F.lit(-2e-6))).collect()] == [100 / (1 + 3e-6)]


def test_overlapping_peaks(spark):
    rows = [(1, 1, 5, 0, 10), (1, 2, 12, 5, 20), (1, 3, 40, 35, 45), (2, 4, 5, 0, 10), (2, 5, 10, 4, 15), (2, 6, 14, 9, 30), (3, 7, 3, 0, 6), (3, 8, 5, 3, 9)]
    got = {tuple(r) for r in indices.untangled(spark.createDataFrame(rows, "t long, id long, apex long, left_base long, right_base long"), "t", "id").collect()}
    # two share out 0 5 10 20, the first apex lies on its new end; three merge into the widest; three scans in common are no overlap
    assert got == {(1, 1, 2, 0, 5), (1, 2, 12, 10, 20), (1, 3, 40, 35, 45), (2, 6, 14, 0, 30), (3, 7, 3, 0, 6), (3, 8, 5, 3, 9)}


def test_one_feature_per_compound(spark):
    rows = [("c1", "f1", 5.0, 0.9, "M+H"), ("c1", "f2", 5.0, 0.95, "M+Na"), ("c2", "f3", 1.0, 0.5, "M+H"), ("c3", "f3", 9.0, 0.5, "M+K"), ("c3", "f9", 1.0, 0.5, "M+H"), ("c4", "f5", 2.0, None, "x"), ("c4", "f6", 9.0, 0.9, "y")]
    got = {tuple(r) for r in indices.one_per_compound(spark.createDataFrame(rows, "c string, f string, area double, fit double, ion string"), "c", "f", "area", "fit", "ion").collect()}
    assert got == {("f2", "c1", "M+Na"), ("f3", "c3", "M+K"), ("f5", "c4", "x")}


def test_distilled_equals_the_correlation_matrix(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(12, 9)) + np.outer(np.arange(12) % 3, np.arange(9))
    values[11] = 4.0  # no variance
    cells = spark.createDataFrame([(i, j, float(values[i, j])) for i in range(12) for j in range(9)], "k long, s long, v double")
    members = spark.createDataFrame([("g", i) for i in range(12)], "g string, k long")
    r = np.corrcoef(values[:11])
    quant = int(r.sum(axis=0).argmax())
    got = {x["k"]: (x["quant"], x["r"]) for x in indices.distilled(members, cells, "g", "k", "s", "v", 0.6).collect()}
    assert got.keys() == {i for i in range(11) if r[quant, i] > 0.6}
    assert all(q == quant and x == pytest.approx(r[quant, i]) for i, (q, x) in got.items())
    assert indices.distilled(members.limit(0), cells, "g", "k", "s", "v", 0.6).count() == 0


def test_upsert(spark):
    known, fresh = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, x string, y int"), spark.createDataFrame([(2, None, 7), (3, "c", 8)], "k long, x string, y int")
    assert {tuple(r) for r in indices.upsert(known, fresh, ["k"]).collect()} == {(1, "a", None), (2, None, 7), (3, "c", 8)}


def test_selectivity_of_peaks(spark):
    row = spark.createDataFrame([([0.0, 8.0, 10.0, 0.0, 6.0, 6.0, 1.0], [(1, 3, 10.0), (6, 6, 1.0), (0, 0, 99.0)])], "v array<double>, p array<struct<left_base:int,right_base:int,height:double>>")
    assert row.select(index.selectivities(F.col("v"), F.col("p")).alias("s")).first()["s"] == [0.5, 0.6, 0.0]


def test_spanning_tree_is_least_and_rooted_in_the_middle(spark):
    rng = np.random.default_rng(6)
    cost = {}
    for a, b in itertools.combinations(range(6), 2):
        cost[a, b] = cost[b, a] = float(rng.integers(1, 9))
    edges = sample_graph.spanning_tree(6, cost)
    every = itertools.combinations([(a, b, c) for (a, b), c in cost.items() if a < b], 5)
    best = min(sum(c for _, _, c in t) for t in every if len(sample_graph.hops(6, t, 0)) == 6)
    assert sum(c for _, _, c in edges) == best and len(sample_graph.hops(6, edges, 0)) == 6
    line = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
    assert sample_graph.root(5, line) == 2 and sample_graph.root(1, []) == 0
    with pytest.raises(ValueError):
        sample_graph.spanning_tree(2, {})
    similar = spark.createDataFrame([("x", "y", 0.75), ("y", "z", 0.5)], "a string, b string, jaccard double")
    assert [tuple(r) for r in sample_graph.alignment_tree(spark, ["x", "y", "z"], similar).collect()] == [("x", "y", 0.25, 1), ("y", "z", 0.5, 1)]


def test_neighbours_shuffle_no_pairs(spark):
    """Profiles with gaps and repeated cells, equal indices and nulls; only features are shuffled, not their pairs."""
    rng = np.random.default_rng(9)
    at = {k: None if k == 5 else float(rng.choice([0.0, 0.5, 1.0, 30.0, 31.9, 90.0])) for k in range(120)}
    cells = [(k, f"s{s}", float(rng.integers(0, 4))) for k in at for s in range(5)]
    frames = spark.createDataFrame(list(at.items()), "k long, ri double").repartition(3), spark.createDataFrame(cells, "k long, s string, v double").repartition(3)
    found = indices.penalised_neighbours(frames[0], frames[0], frames[1], "k", "ri", "s", "v", 0.6, 2.0, 0.4)
    v = np.array([x for _, _, x in cells]).reshape(-1, 5)
    want = {}
    for i, a in at.items():
        for j, b in at.items():
            if a is not None and b is not None and abs(a - b) <= 2 and v[i].std() and v[j].std():
                d = abs(a - b)
                score = np.corrcoef(v[i], v[j])[0, 1] * (1 if d < 0.6 else 2 / (1 + math.exp(d * math.e / 2)))
                assert abs(score - 0.4) > 1e-9
                if score > 0.4:
                    want[i, j] = round(score, 9)
    assert {(r["seed"], r["k"]): round(r["score"], 9) for r in found.collect()} == want and len(want) > 500
    assert "hashpartitioning(seed" not in found._jdf.queryExecution().executedPlan().toString()
