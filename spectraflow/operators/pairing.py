"""One-to-one mapping of sorted lists, and selectivity, by windows inside coarse islands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbourhoods(df: DataFrame, value: str, reach: float) -> DataFrame:
    """Rows once in their own bucket of width ``reach`` (``__own``) and once in each next one, so windows by ``__bucket`` see all neighbours within ``reach``."""
    own = F.floor(F.col(value) / F.lit(float(reach))).cast("long")
    spread = F.explode(F.array(*[F.struct((own + i).alias("b"), F.lit(i == 0).alias("own")) for i in (-1, 0, 1)]))
    return df.withColumn("__to", spread).select(*df.columns, F.col("__to.b").alias("__bucket"), F.col("__to.own").alias("__own"))


def selectivity(df: DataFrame, mz: str, ppm: float = 5.0, reach: float = 1.0) -> DataFrame:
    """Add ``selectivity``: the product of up to two left and two right neighbours' factors.

    A neighbour at x ppm counts 1 beyond 100, 0 below 0.1, else 1 - exp(-x / ppm).
    ``reach`` is at least 100 ppm of the largest value: windows run inside
    buckets of that width and their neighbours; farther values count 1 anyway.
    """
    rows = neighbourhoods(df, mz, reach)
    by = Window.partitionBy("__bucket").orderBy(mz)

    def factor(distance: Column) -> Column:
        return F.coalesce(F.when(distance > 100, 1.0).when(distance < 0.1, 0.0).otherwise(1 - F.exp(-distance / ppm)), F.lit(1.0))

    here = F.col(mz)
    left = [1e6 * (here - F.lag(mz, k).over(by)) / F.lag(mz, k).over(by) for k in (1, 2)]
    right = [1e6 * (F.lead(mz, k).over(by) - here) / here for k in (1, 2)]
    product = factor(left[0]) * factor(left[1]) * factor(right[0]) * factor(right[1])
    return rows.withColumn("selectivity", product).where("__own").drop("__bucket", "__own")


def paired_mapping(left: DataFrame, right: DataFrame, value: str, key: str, ppm: float = 5.0, reach: float = 1.0) -> DataFrame:
    """Pairs (left_key, right_key, left_value, right_value) of neighbours from different lists.

    All values stand in one order (value, list, key). Two neighbours from
    different lists pair if they are less than ``ppm`` of the larger apart and
    the next value is farther than that from the larger. ``reach`` is at least
    the widest tolerance; no window spans more than three buckets of it.
    """
    one = lambda df, n: df.select(F.col(value).cast("double").alias("v"), F.lit(n).alias("side"), F.col(key).alias("k"))
    both = neighbourhoods(one(left, 1).unionByName(one(right, 2)), "v", reach)
    by = Window.partitionBy("__bucket").orderBy("v", "side", "k")
    near = both.select("*", *[F.lag(c).over(by).alias(f"p{c}") for c in ("v", "side", "k")], F.lead("v").over(by).alias("nv")).where("__own")
    limit = F.col("v") * (ppm * 1e-6)
    found = near.where((F.col("side") != F.col("pside")) & (F.col("v") - F.col("pv") < limit) & (F.coalesce(F.col("nv"), F.lit(999999.0)) - F.col("v") > limit))
    first = F.col("side") == 2
    pick = lambda a, b, n: F.when(first, F.col(a)).otherwise(F.col(b)).alias(n)
    return found.select(pick("pk", "k", "left_key"), pick("k", "pk", "right_key"), pick("pv", "v", "left_value"), pick("v", "pv", "right_value"))


def mean_ratio(pairs: DataFrame) -> DataFrame:
    """Mean of (right - left) / left; null when nothing is paired."""
    return pairs.agg(F.avg((F.col("right_value") - F.col("left_value")) / F.col("left_value")).alias("ratio"))


def vector_similarities(queries: DataFrame, library: DataFrame, key: str, vector: str, other: str, block: int = 512) -> DataFrame:
    """``key``, ``other`` (the library row's key), ``cosine`` and ``entropy`` of every query with every library row.

    As ``arrays.cosine`` and ``arrays.entropy_similarity``, for vectors of one
    length without negative cells. Both sides are dealt into blocks of about
    ``block`` rows by hash, and every two blocks are compared.
    """

    def blocks(df: DataFrame, k: str, v: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        parts = df.select(F.pmod(F.xxhash64(key, vector), F.lit(n)).alias("part"), F.struct(F.col(key).alias("k"), F.col(vector).alias("v")).alias("row"))
        return parts.groupBy("part").agg(F.collect_list("row").alias("rows")).select(F.col("rows.k").alias(k), F.col("rows.v").alias(v))

    def matrix(rows) -> np.ndarray:
        width = max((len(r) for r in rows if r is not None), default=0)
        return np.array([np.zeros(width) if r is None else r for r in rows], dtype=float).reshape(len(rows), -1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vectors, others, library in batch.itertuples(index=False, name=None):
                a, b = matrix(vectors), matrix(library)
                lengths = (b * b).sum(axis=1)
                found = []
                for x in a:
                    norm = np.sqrt((x * x).sum() * lengths)
                    cosine = np.divide(b @ x, norm, out=np.zeros(len(b)), where=norm > 0)
                    both = (x > 0) & (b > 0)
                    p, q = np.where(both, x, 0.0), np.where(both, b, 0.0)
                    some = both.any(axis=1)
                    p, q = (s / np.where(some, s.sum(axis=1), 1.0)[:, None] for s in (p, q))
                    m = np.where(both, (p + q) / 2, 1.0)
                    p, q = (s * np.log(np.where(both, s, 1.0) / m) for s in (p, q))
                    found.append((cosine, np.where(some, 1 - (p + q).sum(axis=1) / 2 / np.log(2.0), 0.0)))
                for i, (cosine, entropy) in zip(ids, found):
                    yield pd.DataFrame({key: pd.array([i] * len(others), dtype="Int64"), other: pd.array(list(others), dtype="Int64"), "cosine": cosine, "entropy": entropy})

    pairs = blocks(queries, "k", "v").crossJoin(blocks(library, "l", "w"))
    return pairs.repartition(max(1, pairs.sparkSession.sparkContext.defaultParallelism * 4)).mapInPandas(compare, f"{key} long, {other} long, cosine double, entropy double")
