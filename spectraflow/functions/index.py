"""Expressions over retention indices, calibration ratios and peaks within a vector; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def penalty(delta: Column, least: float = 1.0, most: float = 100.0) -> Column:
    """Weight of two features whose indices are ``delta`` apart: 1 below ``least``, 0 above ``most``, a falling logistic curve between."""
    return F.when(delta > most, 0.0).when(delta < least, 1.0).otherwise(2 / (1 + F.exp(delta * (math.e / most))))


def bracketed(rtime: Column, ladder: Column, end: Column) -> Column:
    """Retention index of ``rtime`` from a sorted ladder of (rtime, index).

    100 * (n + (t - t_n) / (t_next - t)), where n is the last standard before t
    and t_next the first at or after it; behind the last standard t_next is
    1.1 * ``end``. The denominator is from t, not from t_n: that is the formula
    to match. Null before the first standard, infinite at a standard.
    """
    before = F.try_element_at(F.filter(ladder, lambda s: s["rtime"] < rtime), F.lit(-1))
    after = F.coalesce(F.get(F.filter(ladder, lambda s: s["rtime"] >= rtime), F.lit(0))["rtime"], end * 1.1)
    share = F.when(after == rtime, F.lit(math.inf)).otherwise(F.try_divide(rtime - before["rtime"], after - rtime))
    return 100 * (before["index"] + share)


def calibrated(mz: Column, ratio: Column, threshold: float = 2e-6) -> Column:
    """``mz`` without a relative shift of ``ratio``, if that is above ``threshold`` in size."""
    return F.when(F.abs(ratio) > threshold, mz / (1 + ratio)).otherwise(mz)


def selectivities(values: Column, peaks: Column) -> Column:
    """Per peak (left_base, right_base, height) the share of the vector's cells above half its height that lie in any of the peaks; 0 if none do."""
    cells = F.transform(values, lambda x, i: F.struct(x.alias("x"), F.exists(peaks, lambda p: (i >= p["left_base"]) & (i <= p["right_base"])).alias("inside")))
    above = lambda c, p: F.filter(c, lambda s: s["x"] > p["height"] * 0.5)
    share = lambda found: F.when(F.size(found) > 0, F.size(F.filter(found, lambda s: s["inside"])) / F.size(found)).otherwise(0.0)
    # bound once, so that marks are made once per vector
    bound = F.transform(F.array(cells), lambda c: F.transform(peaks, lambda p: F.get(F.transform(F.array(above(c, p)), share), F.lit(0))))
    return F.get(bound, F.lit(0))
