"""Feature tables: counts, filters, pivots, top rows, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detection_counts(df: DataFrame, samples: list[str], name: str = "detection_counts") -> DataFrame:
    """Number of sample columns above 1; absent values don't count."""
    return df.withColumn(name, sum((F.coalesce(F.col(s) > 1, F.lit(False)).cast("int") for s in samples), F.lit(0)))


def preferred(df: DataFrame, snr: float = 2.0, shape: float = 0.7, selectivity: float = 0.7) -> DataFrame:
    """Rows above all limits; shape and selectivity are compared as rounded to two places."""
    good = (F.col("detection_counts") > 0) & (F.col("snr") > snr)
    return df.where(good & (F.round("goodness_fitting", 2) > shape) & (F.round("cSelectivity", 2) > selectivity))


def wide(df: DataFrame, key: str, column: str, values: list[str], cell: Column) -> DataFrame:
    """One row per key and a column per known value; 0 where absent."""
    filled = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values]  # names may hold dots
    return df.groupBy(key).pivot(column, values).agg(cell).select(key, *filled)


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def jaccard(df: DataFrame, group: str, item: str) -> DataFrame:
    """Similarity of every two groups that share an item, by their distinct items."""
    sets = df.select(group, item).distinct()
    sizes = sets.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    a = sets.select(F.col(group).alias("a"), item)
    b = sets.select(F.col(group).alias("b"), item)
    shared = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    x, y = sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), sizes.select(F.col(group).alias("b"), F.col("n").alias("nb"))
    return shared.join(x, "a").join(y, "b").select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def correlations(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Pearson correlation of every two columns of a long table over the rows both have."""
    a = df.select(F.col(row).alias("r"), F.col(column).alias("a"), F.col(value).cast("double").alias("x"))
    b = df.select(F.col(row).alias("r"), F.col(column).alias("b"), F.col(value).cast("double").alias("y"))
    return a.join(b, "r").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
