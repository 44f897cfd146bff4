"""Band and nearest joins as equi-joins on buckets, so they shuffle by key and never cross."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, condition: Column, how: str = "inner") -> DataFrame:
    """Rows whose values are less than ``width`` apart and that meet ``condition``; columns must not clash.

    Both sides get bucket numbers of ``width``; the right goes to its own
    bucket and both neighbours, so each pair meets once.
    """
    a = left.withColumn("__band", F.floor(F.col(left_value) / F.lit(float(width))).cast("long"))
    own = F.floor(F.col(right_value) / F.lit(float(width))).cast("long")
    b = right.withColumn("__other", F.explode(F.array(own - 1, own, own + 1)))
    return a.join(b, (F.col("__band") == F.col("__other")) & condition, how).drop("__band", "__other")


def log_band_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float, condition: Column) -> DataFrame:
    """Pairs that meet ``condition``, which implies at most ``ppm`` of the left value apart and values above 0.

    Buckets are of the logarithm, one tolerance wide, so pairs compared grow
    with pairs found. Neither side is broadcast: the right has three rows for
    one, which its size on disk, by which Spark would choose, doesn't tell.
    """
    width = -math.log1p(-ppm * 1e-6) * (1 + 1e-6)
    of = lambda c: F.floor(F.log(F.col(c)) / width).cast("long")
    a = left.where(F.col(left_mz) > 0).withColumn("__band", of(left_mz))
    b = right.where(F.col(right_mz) > 0).withColumn("__other", F.explode(F.sequence(of(right_mz) - 1, of(right_mz) + 1)))
    return a.join(b.hint("merge"), (F.col("__band") == F.col("__other")) & condition).drop("__band", "__other")


def ppm_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float, reach: float, strict: bool = True, relative_to: str | None = None, how: str = "inner") -> DataFrame:
    """Pairs within ``ppm`` of ``relative_to`` (the left value by default); ``reach`` is at least the widest tolerance."""
    apart, limit = F.abs(F.col(left_mz) - F.col(right_mz)), F.col(relative_to or left_mz) * (ppm * 1e-6)
    return band_join(left, right, left_mz, right_mz, reach, apart < limit if strict else apart <= limit, how)


def by_band(left: DataFrame, right: DataFrame, value: str, reach: float, width: float, kernel: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows ``kernel`` makes of the left and right rows of each band of ``width``; right rows go to all bands that ``reach`` touches.

    Both sides have the same columns; every pair at most ``reach`` apart is in
    one band. Rows are shuffled, pairs never are: a task holds one band at a
    time, and the kernel makes pairs of it in parts that it bounds.
    """
    of = lambda shift: F.floor((F.col(value) + F.lit(float(shift))) / F.lit(float(width))).cast("long")
    known, far = F.col(value).isNotNull(), reach * (1 + 1e-6)
    one = left.where(known).select("*", of(0).alias("__band"), F.lit(0).alias("__side"))
    two = right.where(known).select("*", F.explode(F.sequence(of(-far), of(far))).alias("__band"), F.lit(1).alias("__side"))
    rows = one.unionByName(two).repartition("__band").sortWithinPartitions("__band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def solved() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                side = table.column("__side").to_numpy()
                a, b = (table.filter(pa.array(side == k)).drop_columns(["__band", "__side"]).combine_chunks() for k in (0, 1))
                if len(a) and len(b):
                    yield from kernel(a, b)

        for batch in batches:
            band = batch.column("__band").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
            for low, high in zip(starts, starts[1:]):
                if low < high:
                    if band[low] != now:
                        yield from solved()
                        held, now = [], band[low]
                    held.append(batch.slice(low, high - low))
        yield from solved()

    return rows.mapInArrow(run, schema)


def best_match(pairs: DataFrame, side: str, distance: Column, tie: str) -> DataFrame:
    """One partner per ``side`` value: the nearest, then the first by ``tie``."""
    order = Window.partitionBy(side).orderBy(distance, tie)
    return pairs.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def mutual_best(pairs: DataFrame, left_id: str, right_id: str, distance: Column) -> DataFrame:
    """Pairs that are each other's best."""
    forward = best_match(pairs, left_id, distance, right_id)
    backward = best_match(pairs, right_id, distance, left_id).select(left_id, right_id)
    return forward.join(backward, [left_id, right_id], "left_semi")


def nearest_within(left: DataFrame, right: DataFrame, target: str, right_value: str, reach: float, condition: Column, left_id: str, tie: str) -> DataFrame:
    """For each left row the right value nearest to ``target``, if it meets ``condition``; the smaller ``tie`` wins.

    Of rows with one right value only the smallest ``tie`` can win, and of all
    values only the last at or before a target and the first at or after it; so
    each distinct target meets two at most, found by windows in buckets of
    ``reach``, and nothing grows with the number of pairs.
    """
    others = [c for c in right.columns if c not in (right_value, tie)]
    own = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("long")
    first = F.min(F.struct(tie, *others)).alias("__row")
    rows = right.where(F.col(right_value).isNotNull()).groupBy(F.col(right_value).alias("__v")).agg(first).select(F.struct(F.col("__v").alias(right_value), "__row.*").alias("__r"))
    values = rows.select(F.explode(F.sequence(own(f"__r.{right_value}") - 1, own(f"__r.{right_value}") + 1)).alias("__band"), F.col(f"__r.{right_value}").alias("__v"), "__r")
    targets = left.where(F.col(target).isNotNull()).select(F.col(target).alias("__v")).distinct().select(own("__v").alias("__band"), "__v", F.lit(None).cast(values.schema["__r"].dataType).alias("__r"))
    by = Window.partitionBy("__band").orderBy("__v")
    seen = lambda order: F.last("__r", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    found = values.unionByName(targets).withColumn("__low", seen(by)).withColumn("__high", seen(Window.partitionBy("__band").orderBy(F.desc("__v")))).where("__r IS NULL")
    apart = lambda c: F.abs(F.col("__v") - F.col(f"{c}.{right_value}"))
    near = F.array_compact(F.array(*[F.when(apart(c) < reach, F.struct(apart(c).alias("d"), F.col(f"{c}.{tie}").alias("t"), F.col(c).alias("r"))) for c in ("__low", "__high")]))
    nearest = found.select(F.col("__v"), F.array_min(near)["r"].alias("__r")).where("__r IS NOT NULL")
    pairs = left.join(nearest, F.col(target) == F.col("__v")).select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in right.columns])
    return best_match(pairs, left_id, F.abs(F.col(target) - F.col(right_value)), tie).where(condition)


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")
