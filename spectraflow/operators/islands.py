"""Gaps and islands, without a window over all rows.

Values fall into coarse buckets; only the distinct buckets, few against the
rows, are ordered as a whole. Rows then carry their bucket's island and are
windowed inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coarse_islands(df: DataFrame, value: str, reach: float, name: str = "island", keys: tuple[str, ...] = ()) -> DataFrame:
    """Add an island number; values of different islands (of equal ``keys``) are more than ``reach`` apart."""
    bucket = F.floor(F.col(value) / F.lit(float(reach))).cast("long")
    marked = df.withColumn("__bucket", bucket)
    order = Window.partitionBy(*keys).orderBy("__bucket")
    new = (F.col("__bucket") - F.lag("__bucket").over(order) > 1).cast("int")
    numbered = marked.select(*keys, "__bucket").distinct().withColumn("__new", F.coalesce(new, F.lit(0)))
    numbered = numbered.withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return marked.join(numbered, [*keys, "__bucket"]).drop("__bucket")


def value_islands(df: DataFrame, value: str, breaks, reach: float, name: str = "island") -> DataFrame:
    """Add the first value of a row's run; ``breaks(current, previous)`` says whether a value starts a new one. Rows without a value go.

    Only distinct values are windowed, inside buckets of ``reach``; what one
    bucket hands to the next is ordered as a whole, a row for each bucket.
    """
    values = df.select(F.col(value).alias("__v")).where(F.col(value).isNotNull()).distinct().withColumn("__bucket", F.floor(F.col("__v") / F.lit(float(reach))).cast("long"))
    order = Window.orderBy("__bucket")
    ends = values.groupBy("__bucket").agg(F.max("__v").alias("__e")).select("__bucket", F.lag("__e").over(order).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy("__v")
    previous = F.coalesce(F.lag("__v").over(inside), F.col("__before"))
    first = values.join(ends, "__bucket").withColumn("__first", F.when(F.coalesce(breaks(F.col("__v"), previous), F.lit(True)), F.col("__v")))
    open_ = first.groupBy("__bucket").agg(F.max("__first").alias("__f")).select("__bucket", F.max("__f").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    own = F.max("__first").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    runs = first.join(open_, "__bucket").select("__v", F.coalesce(own, "__carried").alias(name))
    return df.join(runs, F.col(value) == F.col("__v")).drop("__v")


def islands(df: DataFrame, keys: list[str], order: str, breaks, name: str = "island", ties: tuple[str, ...] = ()) -> DataFrame:
    """Number the runs of each group: ``breaks(current, previous)`` says whether a row starts a new one."""
    by = Window.partitionBy(*keys).orderBy(order, *ties)
    new = F.coalesce(breaks(F.col(order), F.lag(order).over(by)).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def mz_bins(df: DataFrame, key: Column, min_points: int, ppm: float, name: str = "bin", keys: tuple[str, ...] = ()) -> DataFrame:
    """Integer buckets (per ``keys``) with at least ``min_points`` rows, chained while the next key is 1 on or within ``ppm`` of its own value."""
    marked = df.withColumn("__key", key.cast("long"))
    counts = marked.groupBy(*keys, "__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_points).drop("__n")
    by = Window.partitionBy(*keys).orderBy("__key")  # distinct buckets only
    gap = F.col("__key") - F.lag("__key").over(by)
    new = F.coalesce((~((gap == 1) | (gap < F.col("__key") * (ppm * 1e-6)))).cast("int"), F.lit(0))
    chained = counts.withColumn("__new", new).withColumn(name, F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return marked.join(chained, [*keys, "__key"]).drop("__key")
