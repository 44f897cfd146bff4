"""Mass tracks from points, and statistics of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.operators.islands import islands


def consensus_mz(points: DataFrame, track: str, mz: str, intensity: str, tie: str) -> DataFrame:
    """Mean of the median m/z and the m/z of the first highest point, per track."""
    top = F.max_by(mz, F.struct(F.col(intensity), -F.col(tie)))
    return points.groupBy(track).agg((0.5 * (F.median(mz) + top)).alias("mz"), F.max(intensity).alias("height"), F.count(F.lit(1)).alias("n_points"))


def composite(points: DataFrame, keys: list[str], intensity: str, name: str = "intensity") -> DataFrame:
    """Samples' intensities summed per key (grid row and scan)."""
    return points.groupBy(*keys).agg(F.sum(intensity).alias(name))


def regions(points: DataFrame, track: str, scan: str, intensity: str, gap: int = 3) -> DataFrame:
    """One row per region of a track, runs of scans less than ``gap`` apart: bounds, apex, height, area and count."""
    best = points.groupBy(track, scan).agg(F.max(intensity).alias("__i"))
    runs = islands(best, [track], scan, lambda now, before: now - before >= gap, "region")
    return runs.groupBy(track, "region").agg(
        F.min(scan).alias("left_base"), F.max(scan).alias("right_base"), F.max_by(scan, F.struct("__i", -F.col(scan))).alias("apex"),
        F.max("__i").alias("height"), F.sum("__i").alias("peak_area"), F.count(F.lit(1)).alias("n_scans"),
    )


def areas(points: DataFrame, keys: list[str], order: list[str], intensity: str) -> DataFrame:
    """Sum, and sum of the larger of each value and the one before it, per group."""
    by = Window.partitionBy(*keys).orderBy(*order)
    larger = F.greatest(F.col(intensity), F.coalesce(F.lag(intensity).over(by), F.lit(0)))
    return points.withColumn("__m", larger).groupBy(*keys).agg(F.sum(intensity).alias("area_sum"), F.sum("__m").alias("area_auc"))


def noise(points: DataFrame, track: str, intensity: str, low: float) -> DataFrame:
    """Baseline and noise: mean and population deviation of the values below the lower quartile plus ``low``."""
    quartile = points.groupBy(track).agg(F.percentile(intensity, F.lit(0.25)).alias("q"))
    below = points.join(quartile, track).where(F.col(intensity) < F.col("q") + low)
    return below.groupBy(track).agg(F.avg(intensity).alias("baseline"), F.stddev_pop(intensity).alias("noise"))


def detrended(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Residuals of a straight line per key."""
    line = points.groupBy(key).agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__c"))
    return points.join(line, key).withColumn("residual", F.col(y) - F.col("__s") * F.col(x) - F.col("__c")).drop("__s", "__c")


def coelution(features: DataFrame, feature: str, rtime: str, tolerance: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of features that elute less than ``tolerance`` apart, as chains; single features drop out.

    In one dimension the components of the graph are the runs of the sorted times.
    """
    runs = islands(features, list(keys), rtime, lambda now, before: now - before >= tolerance, "cluster", (feature,))
    sizes = Window.partitionBy(*keys, "cluster")
    return runs.withColumn("size", F.count(F.lit(1)).over(sizes)).where("size > 1").select(*keys, feature, "cluster", "size")


def interpolate(rows: DataFrame, x: str, knots: list[tuple[float, float]], name: str) -> DataFrame:
    """Piecewise linear through a short list of knots, level beyond its ends."""
    knots = sorted(knots)
    value = F.when(F.col(x) <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        value = value.when(F.col(x) <= x1, y0 + (F.col(x) - x0) * ((y1 - y0) / (x1 - x0)))
    return rows.withColumn(name, value.otherwise(F.lit(float(knots[-1][1]))))
