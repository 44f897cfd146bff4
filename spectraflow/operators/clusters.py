"""Clusters of m/z values and retention times: array kernels, and the operators that run them group by group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.operators.peaks import apart, local_maxima


def mean_filter(values, size: int) -> np.ndarray:
    """Whole part of the mean of ``size`` cells around each, ends repeated; of an even size one cell more lies to the left."""
    v = np.asarray(values, dtype=np.int64)
    left = size // 2
    sums = np.concatenate([[0], np.cumsum(np.pad(v, (left, size - 1 - left), mode="edge"))])
    return np.trunc((sums[size:] - sums[:-size]) / size).astype(np.int64)


def seed_masses(mz, tolerance: float) -> np.ndarray:
    """Centres of the dense places of ``mz``: maxima, a tolerance apart, of the smoothed counts per 0.0001."""
    cells = np.trunc(np.asarray(mz, dtype=float) * 10_000).astype(np.int64)
    reach = int(tolerance * 10_000)
    counts = np.bincount(cells - cells.min() + reach, minlength=int(cells.max() - cells.min()) + 2 * reach + 1)
    smooth = mean_filter(counts, max(2, int(0.5 * reach)))
    tops = local_maxima(smooth.astype(float))
    tops = tops[apart(tops, smooth[tops], reach)]
    return (tops + cells.min() - reach) * 1e-4


def widest_gap(mz) -> np.ndarray:
    """Labels 0 and 1: below and above the first widest gap of sorted values."""
    at = int(np.argmax(np.diff(mz))) + 1 if len(mz) > 1 else len(mz)
    return (np.arange(len(mz)) >= at).astype(int)


def by_seeds(mz, tolerance: float) -> np.ndarray:
    """Each sorted value's cluster: the nearest seed's, the lower on a tie; without a seed the values part at their widest gap."""
    mz = np.asarray(mz, dtype=float)
    seeds = seed_masses(mz, tolerance)
    return np.abs(mz[:, None] - seeds[None, :]).argmin(axis=1) if len(seeds) else widest_gap(mz)


def by_intensity(mz, intensity, tolerance: float) -> np.ndarray:
    """Clusters around the highest values not yet taken, each with all that are less than ``tolerance`` away."""
    mz, label, n = np.asarray(mz, dtype=float), np.full(len(mz), -1), 0
    for i in np.argsort(-np.asarray(intensity, dtype=float), kind="stable"):
        if label[i] < 0:
            label[(label < 0) & (np.abs(mz - mz[i]) < tolerance)] = n
            label[i] = n
            n += 1
    return label


def by_median(values, tolerance: Callable[[float], float]) -> np.ndarray:
    """Runs of sorted values: one joins while it is less than ``tolerance`` of itself above the run's median."""
    label, first = np.zeros(len(values), dtype=int), 0
    for i in range(1, len(values)):
        new = not values[i] - np.median(values[first:i]) < tolerance(values[i])
        first = i if new else first
        label[i] = label[i - 1] + new
    return label


def close_pairs(df: DataFrame, mz: str, key: str, ppm: float = 5.0, reach: float = 1.0) -> DataFrame:
    """(key, before, mz) of values less than ``ppm`` of themselves above the next lower one; of three in a row both pairs."""
    from spectraflow.operators.islands import coarse_islands

    by = Window.partitionBy("island").orderBy(mz, key)
    rows = coarse_islands(df.select(key, mz), mz, reach).withColumn("__m", F.lag(mz).over(by)).withColumn("before", F.lag(key).over(by))
    return rows.where(F.col(mz) - F.col("__m") < F.col(mz) * (ppm * 1e-6)).select(key, "before", mz)


def compact(points: DataFrame, keys: list[str], scan: str, intensity: str, min_points: int = 5, gap: int = 2, min_height: float = 1000.0) -> DataFrame:
    """The groups that are high enough and, if they have fewer than four times ``min_points`` rows, have that many close together.

    Close: the scans of ``min_points`` rows in order span at most ``gap`` + ``min_points`` - 1.
    """
    by = Window.partitionBy(*keys).orderBy(scan)
    spans = points.withColumn("__span", F.col(scan) - F.lag(scan, min_points - 1).over(by))
    good = spans.groupBy(*keys).agg(F.max(intensity).alias("__top"), F.count(F.lit(1)).alias("__n"), F.min("__span").alias("__least"))
    close = (F.col("__n") >= 4 * min_points) | F.coalesce(F.col("__least") <= gap + min_points - 1, F.lit(False))
    return points.join(good.where((F.col("__top") >= min_height) & close).select(*keys), keys)


def split_wide(points: DataFrame, keys: list[str], mz: str, ppm: float = 5.0, name: str = "part") -> DataFrame:
    """Add a number per cluster: 0 in groups narrower than two tolerances (of their lowest value), else that of the nearest seed.

    Narrow groups stay in the JVM; only the wide ones, by definition of few
    tolerances, are gathered.
    """
    by = Window.partitionBy(*keys)
    limit = 2 * F.col("__low") * (ppm * 1e-6)
    marked = points.withColumn("__low", F.min(mz).over(by)).withColumn("__wide", F.max(mz).over(by) - F.col("__low") >= limit)
    narrow = marked.where(~F.col("__wide")).drop("__low", "__wide").withColumn(name, F.lit(0))
    schema = narrow.schema

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(mz, kind="stable")
        labels = by_seeds(frame[mz].to_numpy(dtype=float), float(frame[mz].min()) * ppm * 1e-6)
        return frame.assign(**{name: labels.astype("int32")})[schema.names]

    return narrow.unionByName(marked.where("__wide").drop("__low", "__wide").groupBy(*keys).applyInPandas(solve, schema))


def summed(first: Column, second: Column) -> Column:
    """Cell by cell sum of two intensity vectors of one length."""
    return F.zip_with(first, second, lambda x, y: x + y)
