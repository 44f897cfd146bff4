"""Chromatographic peaks: maxima with prominence and width, Gaussian fits, and both over tables of tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_maxima(v: np.ndarray) -> np.ndarray:
    """Positions above both neighbours; of a plateau the middle, rounded down. Ends don't count."""
    if len(v) < 3:
        return np.empty(0, dtype=int)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    ends = np.r_[starts[1:], len(v)] - 1
    level = v[starts]
    high = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[high] + ends[high]) // 2


def apart(peaks: np.ndarray, heights: np.ndarray, distance: float) -> np.ndarray:
    """Mask of the peaks that stay if the highest rule out others nearer than ``distance``; of equals the later goes first."""
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.lexsort((np.arange(len(peaks)), heights))[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < math.ceil(distance)
            near[i] = False
            keep &= ~near
    return keep


def prominence(v: np.ndarray, peak: int, wlen: float | None = None) -> tuple[float, int, int]:
    """Prominence and the lowest positions left and right before higher ground, inside a window of ``wlen`` cells, rounded up to an odd number."""
    half = len(v) if wlen is None else (math.ceil(wlen) | 1) // 2
    low, high = max(0, peak - half), min(len(v) - 1, peak + half)
    left, right = v[low : peak + 1][::-1], v[peak : high + 1]
    reach = lambda side: int(np.argmax(side > v[peak])) or len(side)
    left, right = left[: reach(left)], right[: reach(right)]
    i, j = int(np.argmin(left)), int(np.argmin(right))
    return float(v[peak] - max(left[i], right[j])), peak - i, peak + j


def crossing(flank: np.ndarray, level: float) -> float:
    """How far from its first cell a flank first comes down to ``level``, between cells by interpolation; its length if it never does."""
    low = np.flatnonzero(flank <= level)
    if not len(low):
        return float(len(flank) - 1)
    k = int(low[0])
    return k - (level - flank[k]) / (flank[k - 1] - flank[k]) if k else 0.0


def width(v: np.ndarray, peak: int, prom: float, left_base: int, right_base: int, rel: float = 0.5) -> float:
    """Width at ``rel`` of the prominence below the top, between the bases."""
    level = v[peak] - prom * rel
    return crossing(v[left_base : peak + 1][::-1], level) + crossing(v[peak : right_base + 1], level)


def find_peaks(v, height: float | None = None, distance: float | None = None, min_prominence: float | None = None, min_width: float | None = None, wlen: float | None = None) -> list[dict]:
    """Maxima that meet all limits (from each limit on), in order: apex, height, prominence, left_base, right_base, width; positions from 0."""
    v = np.asarray(v, dtype=float)
    peaks = local_maxima(v)
    if height is not None:
        peaks = peaks[v[peaks] >= height]
    if distance is not None:
        peaks = peaks[apart(peaks, v[peaks], distance)]
    found = []
    for p in peaks:
        prom, left, right = prominence(v, int(p), wlen)
        if min_prominence is not None and prom < min_prominence:
            continue
        w = width(v, int(p), prom, left, right)
        if min_width is None or w >= min_width:
            found.append({"apex": int(p), "height": float(v[p]), "prominence": prom, "left_base": left, "right_base": right, "width": w})
    return found


def gaussian(x: np.ndarray, a: float, mu: float, sigma: float) -> np.ndarray:
    return a * np.exp(-((x - mu) ** 2) / (2 * sigma * sigma))


def fit_gaussian(x, y, start: tuple[float, float, float], steps: int = 200) -> tuple[float, float, float] | None:
    """Least squares (a, mu, sigma) by damped Gauss-Newton steps; None if they don't become finite."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    at, damping = np.asarray(start, dtype=float), 1e-3
    cost = float(np.sum((y - gaussian(x, *at)) ** 2))
    for _ in range(steps):
        a, mu, sigma = at
        e, d = gaussian(x, 1.0, mu, sigma), x - mu
        jac = np.stack([e, a * e * d / sigma**2, a * e * d**2 / sigma**3], axis=1)
        normal = jac.T @ jac
        try:
            step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-300), jac.T @ (y - a * e))
        except np.linalg.LinAlgError:
            return None
        new = at + step
        changed = float(np.sum((y - gaussian(x, *new)) ** 2)) if new[2] != 0 and np.all(np.isfinite(new)) else math.inf
        if changed <= cost:
            done = np.max(np.abs(step) / (np.abs(at) + 1e-12)) < 1e-12 or cost == changed
            at, cost, damping = new, changed, max(damping / 10, 1e-12)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return (float(at[0]), float(at[1]), abs(float(at[2]))) if np.all(np.isfinite(at)) else None


def goodness(y, fitted) -> float:
    """R squared; 0 for values that are all equal."""
    y = np.asarray(y, dtype=float)
    total = float(np.sum((y - y.mean()) ** 2))
    return 1.0 - float(np.sum((y - fitted) ** 2)) / total if total > 0 else 0.0


def gaussian_area(v, left: int, right: int) -> float:
    """Area under the Gaussian fitted to cells ``left`` up to, without, ``right``; 0 for fewer than three."""
    part = np.asarray(v, dtype=float)[max(0, left) : max(0, right)]
    if len(part) < 3 or part.max() <= 0:
        return 0.0
    x = np.arange(len(part), dtype=float)
    fit = fit_gaussian(x, part, (float(part.max()), float(np.argmax(part)), max(1.0, len(part) / 6)))
    return fit[0] * math.sqrt(2 * math.pi) * fit[2] if fit else 0.0


PEAK = "apex int, height double, prominence double, left_base int, right_base int, width double, area double, goodness double, sigma double"


def detect(tracks: DataFrame, track: str, values: str, min_height: float = 1000.0, min_prominence_ratio: float = 0.02, distance: float = 3, min_width: float = 2.0, shape: float = 0.5) -> DataFrame:
    """One row per peak of each track, a row with its whole intensity vector: track and the columns of ``PEAK``.

    A peak's prominence is at least ``min_prominence_ratio`` of the track's
    largest value, and the R squared of its Gaussian above ``shape``. Tracks
    are independent rows: there is no shuffle, and a track takes the memory of
    its scans only. Null and empty vectors have no peaks.
    """
    kind = tracks.schema[track].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, v in zip(batch["k"], batch["v"]):
                if v is None or len(v) < 3:
                    continue
                v = np.nan_to_num(np.asarray(v, dtype=float))
                for p in find_peaks(v, min_height, distance, min_prominence_ratio * float(v.max()), min_width):
                    x = np.arange(p["left_base"], p["right_base"] + 1)
                    y = v[x]
                    fit = fit_gaussian(x, y, (p["height"], float(p["apex"]), max(0.5, p["width"] / 2.355)))
                    good = goodness(y, gaussian(x, *fit)) if fit and fit[2] else 0.0
                    if good > shape:
                        rows.append((key, *p.values(), float(y.sum()), good, fit[2]))
            yield pd.DataFrame(rows, columns=["k", *[c.split()[0] for c in PEAK.split(", ")]])

    found = tracks.select(F.col(track).alias("k"), F.col(values).cast("array<double>").alias("v")).mapInPandas(run, f"k {kind}, {PEAK}")
    return found.withColumnRenamed("k", track)
