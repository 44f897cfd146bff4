"""Judged peaks against a published value, planted curves and plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from spectraflow.operators import evaluation as ev

# Fixed values, published for this track: apex, bases, height, area and signal to noise.
PUBLISHED = {"apex": 50, "left_base": 38, "right_base": 62, "height": 193264, "area": 2466782, "snr": 193}


def bell(n, at, height, sigma, floor=0.0):
    return floor + height * np.exp(-((np.arange(n) - at) ** 2) / (2 * sigma**2))


def test_a_published_track():
    (peak,) = ev.judged(bell(101, 50, 200000, 5, 1000).astype(int), ev.Limits(), whole=True)
    assert {k: peak[k] for k in PUBLISHED} == PUBLISHED and peak["selectivity"] == 1.0 and peak["goodness"] > 0.999999


def test_audit():
    rng = np.random.default_rng(4)
    limits = ev.Limits(low=100.0, height=1000.0)
    raw = rng.uniform(300, 500, 400) + bell(400, 200, 90000, 4)
    found = ev.audit(raw, limits)
    quiet = [x for x in raw if x < sorted(raw)[100] * 0.25 + sorted(raw)[99] * 0.75 + 100]
    assert math.isclose(found.baseline, sum(quiet) / len(quiet)) and found.noise == 100.0 and found.scale == 1.0
    assert np.allclose(found.values + found.baseline, raw) and math.isclose(found.height, 1000 - found.baseline)
    tall = ev.audit(bell(100, 50, 4e8, 5), limits)
    assert tall.scale == 4.0 and math.isclose(tall.height, max(1000, 4e8 * limits.ratio) - 100)
    cells = bell(100, 50, 1e8, 5)
    around = lambda i: [cells[min(max(i - 4 + k, 0), 99)] for k in range(9)]
    assert np.allclose(tall.values + 100, [sum(around(i)) / 9 for i in range(100)])
    slope = ev.audit(50000 + 100.0 * np.arange(300), ev.Limits(low=100.0, height=1000.0))
    assert abs(slope.values + slope.baseline).max() < 1e-6  # a straight line has nothing left


def test_regions_and_disjoint_peaks():
    v = np.zeros(60)
    v[[5, 6, 8, 9, 11, 20, 21, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39]] = 9
    assert ev.regions(v, 1.0, 3) == [(2, 14), (30, 39)] and ev.regions(v, 10.0, 3) == []
    one = lambda apex, a, b: {"apex": apex, "left_base": a, "right_base": b}
    assert ev.apart([one(9, 2, 20), one(24, 13, 31)]) == [one(9, 2, 13), one(24, 20, 31)]
    assert ev.apart([one(17, 2, 20), one(18, 13, 31)]) == [one(7, 2, 13), one(25, 20, 31)]  # apexes outside their parts
    assert ev.apart([one(9, 2, 20), one(24, 17, 31)]) == [one(9, 2, 20), one(24, 17, 31)]
    assert ev.apart([one(9, 2, 20), one(19, 8, 28), one(40, 22, 60)]) == [one(40, 2, 60)]


def test_noise_and_selectivity_by_counting():
    rng = np.random.default_rng(8)
    v = rng.uniform(0, 100, 500)
    found = [{"left_base": 240, "right_base": 260}, {"left_base": 255, "right_base": 280}]
    inside = ev.covered(found, 500)
    assert inside.sum() == 41
    quiet = [i for i in range(500) if not 240 <= i <= 280]
    left, right = [i for i in quiet if i < 250][-130:-30], [i for i in quiet if i > 250][29:129]
    assert math.isclose(ev.flank_noise(v, inside, 250, ev.Limits(low=1.0), 7.0), sum(v[i] + 1 for i in left + right) / 200)
    high = [i for i in range(500) if v[i] > 40]
    assert math.isclose(ev.selectivity(v, inside, 80), sum(240 <= i <= 280 for i in high) / len(high))
    assert ev.flank_noise(v[:5], np.ones(5, bool), 2, ev.Limits(), 7.0) == 7.0


def test_tables_of_tracks(spark):
    """Planted peaks are found, junk isn't; null, empty and flat tracks and nulls inside have none or do no harm."""
    rng = np.random.default_rng(2)
    two = bell(300, 80, 50000, 4) + bell(300, 200, 30000, 6) + rng.uniform(50, 150, 300)
    rows = [(1, two.tolist()), (2, None), (3, []), (4, [0.0] * 40), (5, rng.uniform(0, 9000, 300).tolist()), (6, [None, *bell(99, 50, 20000, 4).tolist()])]
    limits = ev.Limits(low=200.0, height=1000.0, prominence=330.0, shape=0.9)
    got = ev.evaluated(spark.createDataFrame(rows, "track long, v array<double>"), "track", "v", limits).collect()
    assert sorted((r.track, r.apex) for r in got) == [(1, 80), (1, 200), (6, 51)]
    for r in got:
        assert r.snr > 10 and r.selectivity == 1.0 and r.goodness > 0.99
    empty = spark.createDataFrame([], "track string, v array<long>")
    assert ev.evaluated(empty, "track", "v", limits).count() == 0
    whole = spark.createDataFrame([("a", two.astype(int).tolist())], "track string, v array<long>")
    assert ev.evaluated(whole, "track", "v", limits).select(F.sum("snr")).first()[0] > 0
