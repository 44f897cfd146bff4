import base64
import math
import zlib

import numpy as np

from spectraflow.operators import peaks
from spectraflow.sources import libraries, mzml


def array(values, kind, packed):
    raw = np.asarray(values, "<f8" if kind == "MS:1000514" else "<f4").tobytes()
    width = "MS:1000523" if kind == "MS:1000514" else "MS:1000521"
    extra = '<cvParam accession="MS:1000574"/>' if packed else ""
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    return f'<binaryDataArray><cvParam accession="{kind}"/><cvParam accession="{width}"/>{extra}<binary>{text}</binary></binaryDataArray>'


def spectrum(n, level, minutes, mz, intensity, precursor=None, packed=True):
    chosen = f'<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{precursor}"/></selectedIon></selectedIonList></precursor></precursorList>' if precursor else ""
    return (
        f'<spectrum id="scan={n}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000130"/><scanList><scan>'
        f'<cvParam accession="MS:1000016" value="{minutes}" unitAccession="UO:0000031"/></scan></scanList>{chosen}<binaryDataArrayList>'
        f'{array(mz, "MS:1000514", packed)}{array(intensity, "MS:1000515", packed)}</binaryDataArrayList></spectrum>'
    )


def test_mzml(spark, tmp_path):
    body = (
        spectrum(1, 1, 0.5, [100.0, 200.5], [101.0, 100.9]) + spectrum(2, 2, 0.6, [50.0, 99.5], [500.0, 500.0], 100.0)
        + spectrum(3, 1, 1.0, [300.25], [5000.0], packed=False) + spectrum(4, 1, 1.5, [], [])
    )
    head = '<mzML xmlns="http://psi.hupo.org/ms/mzml"><run startTimeStamp="2024-01-01T00:00:00Z"><spectrumList>'
    for name in ("b.mzML", "a.mzML"):
        (tmp_path / name).write_text(f"{head}{body}</spectrumList></run></mzML>")
    (tmp_path / "other.txt").write_text("no")
    mzml.register(spark)
    spectra = spark.read.format("mzml").load(str(tmp_path))
    assert spectra.count() == 8
    got = sorted((r.file[-6:], r.scan, r.rtime, r.mz, r.intensity) for r in mzml.ms1_points(spectra, 100).collect())
    assert got == sorted((f, *p) for f in ("a.mzML", "b.mzML") for p in [(0, 30.0, 100.0, 101), (1, 60.0, 300.25, 5000)])
    two = mzml.ms2_spectra(spectra).collect()
    assert len(two) == 2 and [p.mz for p in two[0].peaks] == [50.0] and two[0].precursor_mz == 100.0
    assert {r.polarity for r in mzml.polarity(spectra).collect()} == {"pos"}


def test_msp(spark, tmp_path):
    (tmp_path / "l.msp").write_text('Name: first\nPrecursorMZ: 120.5\nNum Peaks: 2\n50.1 10; 60 20\n\nNAME: second: b\nMW: 99\nNum Peaks: 2\n41:100 42:7\n43 5 "C3"\n')
    rows = {r["name"]: r for r in libraries.read_msp(spark, str(tmp_path / "l.msp")).collect()}
    assert set(rows) == {"first", "second: b"}
    assert [tuple(p) for p in rows["first"].peaks] == [(50.1, 10.0), (60.0, 20.0)] and rows["first"].precursor_mz == 120.5
    assert [tuple(p) for p in rows["second: b"].peaks] == [(41.0, 100.0), (42.0, 7.0), (43.0, 5.0)] and rows["second: b"].precursor_mz == 99.0
    out = str(tmp_path / "out")
    libraries.write_msp(spark.createDataFrame(list(rows.values())).select("name", "peaks"), out)
    again = {r["name"]: [tuple(p) for p in r.peaks] for r in libraries.read_msp(spark, out).collect()}
    assert again == {n: [tuple(p) for p in r.peaks] for n, r in rows.items()}


def test_mgf(spark, tmp_path):
    (tmp_path / "l.mgf").write_text("BEGIN IONS\nTITLE=x=1\nPEPMASS=200.5 1000\nCHARGE=2+\n50 10\nbad line\n60.5 20.5\nEND IONS\n\nBEGIN IONS\nTITLE=y\nPEPMASS=1\nEND IONS\n")
    rows = {r.title: r for r in libraries.read_mgf(spark, str(tmp_path / "l.mgf")).collect()}
    assert set(rows) == {"x=1", "y"}
    assert rows["x=1"].charge == 2 and rows["x=1"].precursor_intensity == 1000.0 and [tuple(p) for p in rows["x=1"].peaks] == [(50.0, 10.0), (60.5, 20.5)]
    assert rows["y"].peaks == [] and rows["y"].charge is None


def test_peak_shapes():
    assert list(peaks.local_maxima(np.array([0, 1, 0, 2, 2, 2, 0, 3]))) == [1, 4]
    found = peaks.find_peaks([0, 3, 1, 5, 0])
    assert [(p["apex"], p["prominence"], p["left_base"], p["right_base"]) for p in found] == [(1, 2.0, 0, 2), (3, 5.0, 0, 4)]
    assert [p["apex"] for p in peaks.find_peaks([0, 3, 1, 3, 0], distance=3)] == [3]
    x = np.arange(60)
    for height, middle, sigma in ((800, 31, 4.0), (50, 25.5, 2.5)):
        assert math.isclose(peaks.gaussian_area(height * np.exp(-((x - middle) ** 2) / (2 * sigma**2)), 0, 60), height * sigma * math.sqrt(2 * math.pi), rel_tol=1e-6)
    assert peaks.gaussian_area([1, 2], 0, 2) == 0.0
    assert peaks.prominence(np.array([5.0, 1, 4, 0, 6, 2, 3, 9]), 4, 5.5) == (4.0, 3, 5)


def test_widths_by_walking_down():
    """Width at half prominence against fine steps along the interpolated curve."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        v = np.convolve(rng.random(80), np.ones(5) / 5, mode="same") * 100
        fine = np.arange(0, 79, 0.001)
        curve = np.interp(fine, np.arange(80), v)
        for p in peaks.find_peaks(v):
            level = p["height"] - p["prominence"] / 2
            at = int(round(p["apex"] * 1000))
            left = at - next((k for k in range(at - p["left_base"] * 1000) if curve[at - k] <= level), at - p["left_base"] * 1000)
            right = at + next((k for k in range(p["right_base"] * 1000 - at) if at + k < len(curve) and curve[at + k] <= level), p["right_base"] * 1000 - at)
            assert abs((right - left) / 1000 - p["width"]) < 0.005


def test_detect(spark):
    s = np.arange(90)
    rows = [(1, [float(int(500 + 40000 * math.exp(-((i - 37) ** 2) / 32))) for i in s]), (2, []), (3, None), (4, [0.0] * 50)]
    got = peaks.detect(spark.createDataFrame(rows, "track long, v array<double>"), "track", "v").collect()
    assert [(r.track, r.apex, r.height) for r in got] == [(1, 37, 40500.0)]
    assert got[0].goodness > 0.999 and abs(got[0].sigma - 4) < 0.2
