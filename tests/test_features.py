"""Clusters, matching, spectra, merged tables and a whole run, against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from spectraflow.functions import text
from spectraflow.operators import clusters, matching, merge, spectra
from spectraflow.plans import lc
from spectraflow.sources import tables
from test_sources import spectrum


def test_cluster_kernels():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, 40)
    for size in (2, 3, 6):
        left = size // 2
        cell = lambda i: v[min(max(i, 0), 39)]
        assert list(clusters.mean_filter(v, size)) == [int(sum(cell(i - left + k) for k in range(size)) / size) for i in range(40)]
    a, b = rng.normal(300.0, 0.0004, 80), rng.normal(300.012, 0.0004, 60)
    mz = np.sort(np.concatenate([a, b]))
    label = clusters.by_seeds(mz, 0.0015)
    assert len({l for l, m in zip(label, mz) if m < 300.006} & {l for l, m in zip(label, mz) if m >= 300.006}) == 0
    assert list(clusters.widest_gap([1.0, 2.0, 5.0, 8.0])) == [0, 0, 1, 1]
    assert list(clusters.by_median([1.0, 1.5, 2.2, 4.0, 4.4], lambda x: 1.0)) == [0, 0, 0, 1, 1]
    assert list(clusters.by_intensity([1.0, 1.4, 2.0, 2.3], [5, 9, 7, 1], 0.5)) == [0, 0, 1, 1]


def test_complete_mapping(spark):
    rng = random.Random(7)
    left, right = ([(round(rng.uniform(100, 140), 4), k) for k in range(400)] for _ in range(2))
    merged = sorted([(v, 1, k) for v, k in left] + [(v, 2, k) for v, k in right])
    kept = []
    for i in range(1, len(merged)):
        (pv, ps, pk), (v, s, k) = merged[i - 1], merged[i]
        if s != ps and v - pv < v * 300e-6:
            pair = (v - pv, i, pk if ps == 1 else k, k if s == 2 else pk)
            if kept and kept[-1][1] == i - 1:
                if pair[0] < kept[-1][0]:
                    kept[-1] = pair
            else:
                kept.append(pair)
    frame = lambda rows: spark.createDataFrame(rows, "v double, k long").repartition(3)
    got = matching.complete_mapping(frame(left), frame(right), "v", "k", 300.0, reach=0.05)
    assert {(r["left_key"], r["right_key"]) for r in got.collect()} == {p[2:] for p in kept} and len(kept) > 50
    alone = matching.unmatched(frame(left), "k", got.withColumnRenamed("left_key", "l").withColumnRenamed("l", "left_key"), "left_key")
    assert alone.count() == 400 - len(kept)


def test_landmark_mapping_corrects_a_shift(spark):
    rng = random.Random(2)
    masses = [100 + 3 * k + rng.random() for k in range(60)]
    reference = spark.createDataFrame([(k, m, k % 2 == 0) for k, m in enumerate(masses)], "id long, mz double, landmark boolean")
    sample = spark.createDataFrame([(1000 + k, m * (1 + 4e-6), k % 2 == 0) for k, m in enumerate(masses) if k != 5] + [(5000, 999.5, False)], "id long, mz double, landmark boolean")
    got = matching.landmark_mapping(reference, sample, 5.0, 1.0).collect()
    pairs = {r["reference_id"]: r["sample_id"] for r in got if r["reference_id"] is not None}
    assert pairs == {k: None if k == 5 else 1000 + k for k in range(60)}
    assert [r["sample_id"] for r in got if r["reference_id"] is None] == [5000]
    assert all(abs(r["mz"] / masses[r["reference_id"]] - 1) < 1e-7 for r in got if r["reference_id"] is not None)


def test_compare(spark):
    left = spark.createDataFrame([("a", 200.0, 10.0), ("b", 300.0, 20.0), ("c", 300.0005, 21.0)], "id string, mz double, rtime double")
    right = spark.createDataFrame([("x", 200.0006, 12.0), ("y", 300.0004, 22.0), ("z", 500.0, 1.0)], "id string, mz double, rtime double")
    got = {(r["left_id"], r["right_id"]): (round(r["ppm_error"], 2), r["rt_delta"]) for r in matching.compare(left, right).collect()}
    assert got == {("a", "x"): (3.0, 2.0), ("c", "y"): (-0.33, 1.0)}


def test_spectrum_scores():
    a = [(50.0, 10.0), (60.0, 40.0), (70.0, 100.0)]
    assert spectra.matched_cosine(a, a) == (1.0, 3) and math.isclose(spectra.matched_entropy(a, a, 0.1), 1.0)
    assert spectra.matched_cosine(a, [(55.0, 1.0)]) == (0.0, 0) and spectra.matched_entropy([], a, 0.1) == 0.0
    score, n = spectra.matched_cosine(a, [(60.05, 5.0)], root=False)
    assert n == 1 and math.isclose(score, 0.4 / math.sqrt(0.01 + 0.16 + 1))
    assert spectra.matched_cosine(a, [(60.05, 5.0)], root=False, penalty=1.0) == (1.0, 1)
    assert spectra.matched_cosine(a, [(60.0, 3.0), (60.05, 5.0)], root=False)[1] == 1  # a peak is taken once


def test_library_search_makes_pairs_from_peaks(spark):
    """Scores are those of each pair by itself, at bands' edges and of empty spectra too; spectra are never joined to pairs."""
    rng = random.Random(5)
    of = lambda n: [(k, rng.choice([-40.0, 0.0, 79.5, 80.0, 84.5, 300.0]) + rng.randrange(9) / 2, None if k == 3 else [(float(rng.randrange(9)), float(rng.randrange(7))) for _ in range(rng.randrange(6))]) for k in range(n)]
    left, right = of(160), of(170)
    kind = "id long, precursor_mz double, peaks array<struct<mz: double, intensity: double>>"
    found = spectra.search_library(*[spark.createDataFrame(t, kind).repartition(3) for t in (left, right)], 5.0, 0.5, 0.1)
    want = {}
    for i, x, a in left:
        for j, y, b in right:
            score, n = spectra.matched_cosine(a or [], b or [], 0.5)
            if abs(x - y) <= 5 and score >= 0.1:
                want[i, j] = (score, n, spectra.matched_entropy(a, b, 0.5))
    got = {(r["spectrum_id"], r["library_id"]): (r["cosine"], r["n_matched"], r["entropy"]) for r in found.collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    assert all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=1e-12) for k in want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_merge(spark):
    rows = [("t1", 1, 200.0, 10.0), ("t2", 2, 200.0004, 12.0), ("t3", 3, 200.0002, 40.0), ("t1", 4, 200.0003, 11.0), ("t2", 5, 350.0, 5.0)]
    got = merge.consensus(spark.createDataFrame(rows, "table string, id long, mz double, rtime double")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["group"]].add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3], [4], [5]] or sorted(map(sorted, groups.values())) == [[1], [2, 4], [3], [5]]
    cells = spark.createDataFrame([(t, i, 10 * i) for t, i, _, _ in rows], "table string, id long, area long")
    wide = merge.merged(spark.createDataFrame(rows, "table string, id long, mz double, rtime double"), cells, ["t1", "t2", "t3"]).collect()
    assert sum(r["t1"] + r["t2"] + r["t3"] for r in wide) == 150 and max(r["n_tables"] for r in wide) == 2


def test_merge_settles_each_run_by_itself(spark):
    """Dense steps wider than the tolerance, copies, a chain of near values, ties and nulls: as one pass over all rows in order."""
    rng = random.Random(11)
    rows = [(f"t{rng.randrange(3)}", k, rng.randrange(3000, 3150) / 10, float(rng.randrange(20))) for k in range(2000)]
    rows += [(f"t{k % 3}", 10_000 + k, 305.0, 4.0) for k in range(90)] + [(f"t{rng.randrange(4)}", 20_000 + k, 400 + rng.randrange(300) / 1000, rng.randrange(40) / 2) for k in range(700)]
    groups, want = [], {}
    for table, k, mz, rtime in sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1])):
        d = mz * 20.0 * 1e-6
        near = [(abs(g["mz"] - mz) / d + abs(g["rt"] - rtime) / 3.0, n) for n, g in enumerate(groups) if mz - d < g["mz"] <= mz + d and abs(g["rt"] - rtime) <= 3.0 and table not in g["tables"]]
        n = min(near)[1] if near else len(groups)
        if not near:
            groups.append({"tables": set(), "mzs": [], "rts": []})
        g = groups[n]
        g["tables"].add(table), g["mzs"].append(mz), g["rts"].append(rtime)
        g["mz"], g["rt"] = float(np.median(g["mzs"])), float(np.median(g["rts"]))
        want[k] = n
    frame = spark.createDataFrame([*rows, ("t1", 90_000, 305.0, None), ("t2", 90_001, None, 1.0)], "table string, id long, mz double, rtime double").repartition(5)
    got = {r["id"]: r for r in merge.consensus(frame, 20.0, 3.0, reach=1.0).collect()}
    assert got.keys() == want.keys() | {90_000} and got[90_000]["group_rtime"] is None
    assert all((got[k]["group_mz"], got[k]["group_rtime"]) == (groups[n]["mz"], groups[n]["rt"]) for k, n in want.items())
    assert len({(n, got[k]["group"]) for k, n in want.items()}) == len(groups) == len({got[k]["group"] for k in want})
    assert len({r["group"].rsplit("_", 1)[0] for r in got.values()}) > 140


def test_text(spark):
    one = spark.createDataFrame([("a/b: <c>. .", 1536)], "s string, n long")
    r = one.select(text.safe_filename(F.col("s")).alias("a"), text.html_escape(F.col("s")).alias("b"), text.human_size(F.col("n")).alias("c"), text.as_markdown(F.create_map(F.lit("k"), F.col("s")), "T").alias("d")).first()
    assert tuple(r) == ("a_b_ _c_", "a/b: &lt;c&gt;. .", "1.5KiB", "### T\n- **k**: a/b: <c>. .")
    assert text.truth("TRUE") and not text.truth("0")


def test_sizes_round_as_printf(spark):
    """Of the exact value, ties to the even digit; a null stays null."""
    rng = random.Random(4)
    sizes = [0, 1023, 1280, 1792, -1280, 1310720, 2**62, *(1280 * k for k in range(1, 200)), *(rng.randrange(1 << rng.randrange(1, 63)) for _ in range(300))]

    def plain(n):
        x, k = float(n), 0
        while abs(x) >= 1024:
            x, k = x / 1024, k + 1
        return f"{x:.1f}{text.UNITS[k]}B"

    got = spark.createDataFrame([(n,) for n in [*sizes, None]], "n long").select("n", text.human_size(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == {n: plain(n) for n in sizes} | {None: None}
    values = [0.05, 0.15, 0.25, 0.45, -0.75, 999.95, *(rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(300))]
    assert all(r["t"] == f"{r['x']:.1f}" for r in spark.createDataFrame([(x,) for x in values], "x double").select("x", text.one_decimal(F.col("x")).alias("t")).collect())


def test_a_whole_run(spark, tmp_path):
    """Two samples with three compounds each give the three features, with every sample's area; they are written and read back."""
    shapes = [(150.05, 12, 30000.0), (220.1, 25, 50000.0), (301.2, 40, 20000.0)]
    rng = np.random.default_rng(1)
    (tmp_path / "in").mkdir()
    for name, factor in (("one.mzML", 1.0), ("two.mzML", 0.5)):
        scans = ""
        for s in range(60):
            points = sorted((m * (1 + rng.normal(0, 5e-7)), factor * h * math.exp(-((s - at) ** 2) / 18)) for m, at, h in shapes)
            points = [(m, i) for m, i in points if i > 110]
            scans += spectrum(s, 1, s / 60, [m for m, _ in points], [i for _, i in points])
        (tmp_path / "in" / name).write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run startTimeStamp="2024-01-01T00:00:00Z"><spectrumList>{scans}</spectrumList></run></mzML>')
    features = lc.process(spark, str(tmp_path / "in"), lc.Parameters().with_text(lc.read_parameters(["min_timepoints: 4  # few", "ppm = 5"])))
    got = sorted(features.collect(), key=lambda r: r["mz"])
    assert [round(r["mz"], 2) for r in got] == [150.05, 220.1, 301.2] and [r["apex"] for r in got] == [12, 25, 40]
    for r, (_, _, h) in zip(got, shapes):
        assert abs(r["height"] / (1.5 * h) - 1) < 0.01 and r["detection_counts"] == 2
        assert abs(r["one.mzML"] / (h * 3 * math.sqrt(2 * math.pi)) - 1) < 0.05 and abs(r["two.mzML"] / r["one.mzML"] - 0.5) < 0.05
    lc.export(features, str(tmp_path / "out"))
    back = tables.read_features(spark, str(tmp_path / "out" / "preferred"))
    assert back.count() == 3 and set(tables.sample_columns(back)) >= {"one.mzML", "two.mzML"}
