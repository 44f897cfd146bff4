import numpy as np

from spectraflow.operators import alignment


def plain_lowess(x, y, frac, iterations):
    """Cleveland's robust local lines by weighted least squares, point by point."""
    n = len(x)
    k, trust = max(2, min(n, int(frac * n + 1e-7))), np.ones(n)
    for left in range(iterations, -1, -1):
        fitted = np.empty(n)
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3 * trust)
            design = np.stack([np.ones(n), x - x[i]], axis=1) * w[:, None]
            fitted[i] = np.linalg.lstsq(design, y * w, rcond=None)[0][0]
        off = np.abs(y - fitted)
        trust = np.clip(1 - (off / (6 * np.median(off))) ** 2, 0, None) ** 2 if left else trust
    return fitted


def test_lowess():
    rng = np.random.default_rng(11)
    x = np.sort(rng.uniform(0, 40, 60))
    y = np.sin(x / 6) * 4 + rng.normal(0, 0.3, 60)
    for frac, iterations in ((0.3, 0), (0.5, 2), (0.7, 3)):
        assert np.allclose(alignment.lowess(x, y, frac, iterations), plain_lowess(x, y, frac, iterations), atol=0.01)


def test_interpolate():
    assert np.allclose(alignment.interpolate([2, 5, 6], [1, 7, 6], [0, 2, 3, 5.5, 8]), [-3, 1, 3, 6.5, 4])


def test_calibrate(spark):
    """A run stretched by a twentieth is mapped to its reference and back; a level one has no map."""
    apexes = list(range(20, 400, 9))
    rows = [("stretched", a, round(a * 1.05) + (a % 2)) for a in apexes] * 2 + [("level", a, a) for a in apexes]
    got = alignment.calibrate(spark.createDataFrame(rows, "sample string, apex int, reference_apex int"), 420, 441).collect()
    assert {r["sample"] for r in got} == {"stretched"}
    for r in got:
        if 40 < r.source < 380:
            assert abs(r.target - (r.source * 1.05 if r.direction == "forward" else r.source / 1.05)) <= 2


def test_remap(spark):
    cells, forward = {0: 5, 1: 6, 4: 9, 7: 2}, {0: 1, 4: 5, 7: 5}
    points = spark.createDataFrame([("s", i, v) for i, v in cells.items()], "sample string, scan int, intensity int")
    maps = spark.createDataFrame([("s", "forward", a, b) for a, b in forward.items()] + [("s", "reverse", 1, 0)], "sample string, direction string, source int, target int")
    want = dict(cells)
    for a in sorted(forward):
        want[forward[a]] = cells[a]
    assert {r.scan: r.intensity for r in alignment.remap(points, maps, ["sample"]).collect()} == want
