"""Retention time alignment: LOWESS through landmarks, one sample a group, and tracks moved along the maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# The smoothing share up to a number of landmarks, how it falls with each further one, and its least;
# points that hold either end of the curve, and how far beyond the run they lie, as a share of it.
MOST_SHARE, FEW_LANDMARKS, SHARE_FALL, LEAST_SHARE = 0.6, 50, 0.004, 0.2
HOLDING, BEYOND = 3, 0.1


def lowess(x, y, frac: float = 2 / 3, iterations: int = 3) -> np.ndarray:
    """Robust locally weighted lines (Cleveland 1979) at every x, which ascends; ``iterations`` robust rounds follow the first fit."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    n = len(x)
    if n < 2:
        return y.copy()
    nearest, spread = max(2, min(n, int(frac * n + 1e-7))), x[-1] - x[0]
    trust, fitted = np.ones(n), np.empty(n)
    for left in range(iterations, -1, -1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.partition(d, nearest - 1)[nearest - 1]
            scaled = d / h if h > 0 else np.where(d > 0, 2.0, 0.0)
            w = np.where(scaled <= 0.001, 1.0, np.where(scaled <= 0.999, (1 - np.minimum(scaled, 1) ** 3) ** 3, 0.0)) * trust
            if w.sum() <= 0:
                fitted[i] = y[i]
                continue
            w /= w.sum()
            middle = w @ x
            variance = w @ (x - middle) ** 2
            slope_part = (x[i] - middle) / variance * (x - middle) if h > 0 and np.sqrt(variance) > 0.001 * spread else 0.0
            fitted[i] = (w * (1 + slope_part)) @ y
        if not left:
            break
        off = np.abs(y - fitted)
        scale = 6 * np.median(off)
        if scale < 1e-7 * off.mean() or scale == 0:
            break
        trust = np.where(off <= 0.001 * scale, 1.0, np.where(off <= 0.999 * scale, (1 - (off / scale) ** 2) ** 2, 0.0))
    return fitted


def interpolate(x, y, at) -> np.ndarray:
    """Piecewise linear through ascending x, with the end segments drawn on beyond both ends."""
    x, y, at = (np.asarray(v, dtype=float) for v in (x, y, at))
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    return y[k] + (at - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])


def clean_landmarks(landmarks: DataFrame, sample: str = "sample") -> DataFrame:
    """Distinct pairs (apex, reference_apex) whose difference is within three population deviations of the sample's mean, ends excluded."""
    by = Window.partitionBy(sample)
    apart = F.col("apex") - F.col("reference_apex")
    rows = landmarks.select(sample, "apex", "reference_apex").distinct().withColumn("__d", apart)
    rows = rows.withColumn("__m", F.avg("__d").over(by)).withColumn("__s", 3 * F.stddev_pop("__d").over(by))
    return rows.where(F.abs(F.col("__d") - F.col("__m")) < F.col("__s")).drop("__d", "__m", "__s")


def calibrate(landmarks: DataFrame, last_scan: int, reference_last_scan: int, iterations: int = 1, sample: str = "sample") -> DataFrame:
    """Maps sample, direction ("forward" to the reference, "reverse" from it), source, target; only scans that change and stay in range.

    The smoothing share falls from 0.6 to 0.2 as landmarks become more than 50;
    three points beyond each end hold the curve. A sample without landmarks
    left has no rows: its scans stay.
    """
    kind = landmarks.schema[sample].dataType.simpleString()

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        forward = forward_curve(frame["apex"].to_numpy(dtype=float), frame["reference_apex"].to_numpy(dtype=float), last_scan, iterations)
        maps = {"forward": moved(forward, reference_last_scan), "reverse": moved(reverse_curve(forward, reference_last_scan), last_scan)}
        return pd.concat([pd.DataFrame({sample: key[0], "direction": name, "source": source, "target": target}) for name, (source, target) in maps.items()])

    return clean_landmarks(landmarks, sample).groupBy(sample).applyInPandas(solve, f"{sample} {kind}, direction string, source int, target int")


def forward_curve(apex: np.ndarray, reference: np.ndarray, last_scan: int, iterations: int) -> np.ndarray:
    """The reference time, as a fraction of scans, of every scan of a sample."""
    share = np.clip(MOST_SHARE - SHARE_FALL * (len(apex) - FEW_LANDMARKS), LEAST_SHARE, MOST_SHARE)
    ends = np.repeat([-BEYOND * last_scan, (1 + BEYOND) * last_scan], HOLDING)
    points = np.concatenate([np.stack([apex, reference]), np.stack([ends, ends])], axis=1)
    x, y = points[:, np.lexsort(points[::-1])]
    knots, first = np.unique(x, return_index=True)
    return np.interp(np.arange(last_scan + 1), knots, lowess(x, y, share, iterations)[first])


def reverse_curve(forward: np.ndarray, reference_last_scan: int) -> np.ndarray:
    """The sample's scan of every reference scan: the forward curve read the other way."""
    times, scans = np.unique(forward, return_index=True)
    every = np.arange(reference_last_scan + 1)
    return interpolate(times, scans, every) if len(times) > 1 else every.astype(float)


def moved(curve: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Scans that the rounded curve moves, and where to, within 0 to ``bound``."""
    target = np.rint(curve).astype(int)
    source = np.flatnonzero((target != np.arange(len(curve))) & (target >= 0) & (target <= bound))
    return source, target[source]


def remap(points: DataFrame, forward: DataFrame, keys: list[str], scan: str = "scan", intensity: str = "intensity", sample: str = "sample") -> DataFrame:
    """Every cell stays; a mapped cell is also written over its target, of several the last source's. ``keys`` include the sample."""
    moves = forward.where("direction = 'forward'").select(sample, F.col("source").alias(scan), "target")
    stays = points.select(*keys, F.col(scan).alias("to"), intensity, F.lit(-1).alias("from"))
    moved = points.join(moves, [sample, scan]).select(*keys, F.col("target").alias("to"), intensity, F.col(scan).alias("from"))
    best = stays.unionByName(moved).groupBy(*keys, "to").agg(F.max_by(intensity, "from").alias(intensity))
    return best.withColumnRenamed("to", scan)
