"""Catalog queries against plain versions, on small tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from spectraflow import catalog
from spectraflow.functions import mass
from spectraflow.operators import bands, matching


def test_lib_cosine_searches_the_whole_library(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in np.where(rng.random(8) < 0.4, 0, rng.normal(size=8)).astype(np.float32)] for i in range(1130)}
    vectors[50], vectors[7] = [0.0] * 8, [0.0] * 8
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["vec_id"], r["lib_id"]): (r["cosine"], r["entropy"]) for r in catalog.lib_cosine(spark, str(tmp_path)).collect()}
    assert len(got) == 23 * 1130
    for i in range(0, 1130, 50):
        for j in range(1130):
            a, b = [abs(x) for x in vectors[i]], [abs(x) for x in vectors[j]]
            norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            cosine = sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0
            cells = [(x, y) for x, y in zip(a, b) if x > 0 and y > 0]
            s, t = sum(x for x, _ in cells), sum(y for _, y in cells)
            parts = [(x / s, y / t) for x, y in cells]
            entropy = 1 - sum(p * math.log(2 * p / (p + q)) + q * math.log(2 * q / (p + q)) for p, q in parts) / 2 / math.log(2) if cells else 0.0
            assert abs(got[i, j][0] - cosine) < 2e-6 and abs(got[i, j][1] - entropy) < 2e-6


def test_jaccard_samples_takes_every_part(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(s), int(p)) for s, p in zip(rng.integers(1, 60, 900), rng.integers(1, 90, 900))]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = {}
    for s, p in rows:
        parts.setdefault(s % 20, set()).add(p)
    want = {(a, b): round(len(parts[a] & parts[b]) / len(parts[a] | parts[b]), 8) for a in parts for b in parts if a < b and parts[a] & parts[b]}
    got = {(r["a"], r["b"]): r["jaccard"] for r in catalog.jaccard_samples(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-8 for k in want)


def test_paired_mapping_takes_every_positive_balance(spark, tmp_path):
    spark.createDataFrame([(1, 50.0), (2, 0.0), (3, -7.0), (4, 900.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(8, 50.01), (9, 900.1), (10, -7.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["left_key"], r["right_key"]) for r in catalog.paired_mapping(spark, str(tmp_path)).collect()}
    assert got == {(1, 8), (4, 9)}


def test_nearest_compares_no_pairs_of_copies(spark):
    """Many rows of one value: each target meets two values at most, ties by the smaller key; null and far values find nothing."""
    rng = np.random.default_rng(6)
    left = [(i, None if i % 90 == 0 else float(rng.integers(0, 400)) / 4) for i in range(700)] + [(9000, 1e6)]
    right = [(int(k), float(rng.choice([3.0, 10.25, 10.75, 40.0, 41.5, 77.0]))) for k in rng.permutation(6000)] + [(7000, None)]
    frames = spark.createDataFrame(left, "l long, t double").repartition(3), spark.createDataFrame(right, "r long, v double").repartition(3)
    found = bands.nearest_within(*frames, "t", "v", 8.0, F.abs(F.col("t") - F.col("v")) < 5, "l", "r")
    want = {}
    for k, t in left:
        near = min(((abs(t - v), r) for r, v in right if v is not None), default=None) if t is not None else None
        if near and near[0] < 5:
            want[k] = near[1]
    assert {r["l"]: r["r"] for r in found.collect()} == want and len(want) > 200
    assert not [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "__band" in line]


def test_annotation_broadcasts_no_ions(spark):
    """A compound becomes a dozen rows, which its size on disk doesn't tell; values at or below 0 match nothing."""
    rng = np.random.default_rng(8)
    neutral = [(k, float(m)) for k, m in enumerate(rng.uniform(100, 130, 400))] + [(900, -20.0)]
    lines = [(k, float(m)) for k, m in enumerate(rng.uniform(100, 130, 3000))] + [(9000, 0.0), (9001, -5.0)]
    frames = spark.createDataFrame(lines, "f long, mz double").repartition(3), spark.createDataFrame(neutral, "c long, m double").repartition(3)
    found = matching.annotate(*frames, "f", "mz", "c", "m", "pos", 20.0, 1.0)
    ions = [(c, ion, m + mass.PROTON + d) for c, m in neutral for ion, d in mass.POSITIVE_ADDUCTS.items()]
    want = {(f, c, ion) for f, mz in lines for c, ion, x in ions if mz - mz * 20e-6 < x <= mz + mz * 20e-6}
    assert {(r["f"], r["c"], r["ion"]) for r in found.collect()} == want and len(want) > 100
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
