"""Retention indices, features that vary together, overlapping peaks, one feature per compound, upserts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.functions import index as ix
from spectraflow.operators import bands


def retention_index(points: DataFrame, ladder: DataFrame, sample: str, rtime: str, standard: str, index: str) -> DataFrame:
    """Add ``ri`` to the points of samples with a ladder (sample, standard's time, index); see ``functions.index.bracketed``.

    Only the ladders, some dozen standards a sample, are gathered; points meet
    them by an equi-join, whose broadcast is the optimizer's choice by size.
    """
    steps = ladder.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(standard).cast("double").alias("rtime"), F.col(index).cast("double").alias("index")))).alias("__ladder"))
    ends = points.groupBy(sample).agg(F.max(rtime).cast("double").alias("__end"))
    t = F.col(rtime).cast("double")
    return points.join(steps.join(ends, sample), sample).withColumn("ri", ix.bracketed(t, F.col("__ladder"), F.col("__end"))).drop("__ladder", "__end")


def standardised(cells: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``z``, so that the sum of two keys' products is their Pearson correlation; keys without variance go. Every key has a row for every sample."""
    by = cells.groupBy(key).agg(F.avg(value).alias("__mean"), (F.stddev_pop(value) * F.sqrt(F.count(value))).alias("__length"))
    return cells.join(by.where("__length > 0"), key).withColumn("z", (F.col(value) - F.col("__mean")) / F.col("__length")).drop("__mean", "__length")


def distilled(members: DataFrame, cells: DataFrame, group: str, key: str, sample: str, value: str, cutoff: float = 0.6) -> DataFrame:
    """Per group the feature that all others resemble most (``quant``), and the members that correlate with it above ``cutoff``: group, quant, key, r.

    The sum of a feature's correlations with its whole group is its product
    with the group's summed profile, so no pairs of members are made. Sums are
    compared to nine places, the smallest key wins ties. Members without
    variance have no correlation and go.
    """
    z = members.join(standardised(cells.select(key, sample, F.col(value).cast("double").alias(value)), key, value), key).select(group, key, sample, "z")
    profile = z.groupBy(group, sample).agg(F.sum("z").alias("__s"))
    like = z.join(profile, [group, sample]).groupBy(group, key).agg(F.round(F.sum(F.col("z") * F.col("__s")), 9).alias("__like"))
    quant = like.groupBy(group).agg(F.min(F.struct((-F.col("__like")).alias("a"), F.col(key).alias("quant")))["quant"].alias("quant"))
    chosen = z.join(quant.withColumn(key, F.col("quant")), [group, key]).select(group, "quant", sample, F.col("z").alias("__q"))
    r = z.join(chosen, [group, sample]).groupBy(group, "quant", key).agg(F.sum(F.col("z") * F.col("__q")).alias("r"))
    return r.where(F.col("r") > cutoff)


def penalised_neighbours(seeds: DataFrame, features: DataFrame, cells: DataFrame, key: str, ri: str, sample: str, value: str, least: float = 1.0, most: float = 100.0, cut: float = 0.5) -> DataFrame:
    """Features whose correlation with a seed, times the penalty of their distance in index, is ``cut`` (above 0) or more: seed, key, score. A seed is its own neighbour.

    Profiles travel with their features to bands of ``most``, where blocks of
    seeds are multiplied with all features near; only rows of the result leave
    a task. The penalty is 1 at most, so correlations below ``cut`` go first.
    """
    z = standardised(cells.select(key, sample, F.col(value).cast("double").alias(value)), key, value).where(F.col("z").isNotNull() & F.col(sample).isNotNull())
    profiles = z.groupBy(key).agg(F.collect_list(F.col(sample)).alias("__samples"), F.collect_list("z").alias("__z"))
    kind = dict(profiles.dtypes)[key]

    def flat(t: pa.Table, c: str) -> pa.Array:
        return pa.concat_arrays([x.flatten() for x in t.column(c).chunks])

    def compare(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = pa.concat_arrays([flat(a, "__samples"), flat(b, "__samples")]).dictionary_encode()
        column, width, z = codes.indices.to_numpy(), len(codes.dictionary), []
        for t, at in ((a, 0), (b, len(flat(a, "__samples")))):
            row = np.repeat(np.arange(len(t)), pc.list_value_length(t.column("__z")).to_numpy())
            z.append(np.bincount(row * width + column[at : at + len(row)], weights=flat(t, "__z").to_numpy(), minlength=len(t) * width).reshape(len(t), width))
        x, y = (t.column("__ri").to_numpy() for t in (a, b))
        ids = [t.column(key).combine_chunks() for t in (a, b)]
        ids = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in ids]
        block = max(1, (1 << 21) // len(b))
        for at in range(0, len(a), block):
            r = z[0][at : at + block] @ z[1].T
            i, j = np.nonzero(r >= cut * (1 - 1e-9))
            apart = np.abs(x[at + i] - y[j])
            score = r[i, j] * np.where(apart < least, 1.0, 2 / (1 + np.exp(np.minimum(apart * (math.e / most), 700.0))))
            kept = np.flatnonzero((score >= cut) & (apart <= most))
            yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(at + i[kept])), ids[1].take(pa.array(j[kept])), pa.array(score[kept])], names=["seed", key, "score"])

    side = lambda df: df.select(key, F.col(ri).cast("double").alias("__ri")).distinct().join(profiles, key)
    return bands.by_band(side(seeds), side(features), "__ri", most, most * 2, compare, f"seed {kind}, {key} {kind}, score double")


def untangled(peaks: DataFrame, track: str, key: str, least: int = 3) -> DataFrame:
    """Peaks (apex, left_base, right_base) of a track without overlaps, in the order of their apexes.

    A peak that shares more than ``least`` scans with the one before it is in
    its cluster. Two peaks share out their sorted four bases, and an apex that
    is then not inside becomes the middle; of more the widest stays and takes
    the whole range. Clusters are aggregated, not gathered.
    """
    by = Window.partitionBy(track).orderBy("apex", key)
    left, right = F.lag("left_base").over(by), F.lag("right_base").over(by)
    shared = F.when(F.col("right_base") > right, right - F.col("left_base")).otherwise(F.col("right_base") - left)
    chained = peaks.select(track, key, "apex", "left_base", "right_base", F.coalesce(shared <= least, F.lit(True)).cast("int").alias("__new"))
    numbered = chained.withColumn("__c", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("apex", F.col(key).alias("k"), "left_base", "right_base")
    wide = F.struct((F.col("left_base") - F.col("right_base")).alias("w"), "apex", F.col(key).alias("k"))
    found = numbered.groupBy(track, "__c").agg(
        F.count(F.lit(1)).alias("n"), F.min(one).alias("a"), F.max(one).alias("b"), F.min(wide).alias("w"), F.min("left_base").alias("low"), F.max("right_base").alias("high")
    )
    bases = F.array_sort(F.array("a.left_base", "a.right_base", "b.left_base", "b.right_base"))

    def part(p: str, i: int) -> Column:
        lo, hi, apex = bases[i], bases[i + 1], F.col(f"{p}.apex")
        middle = ((lo + hi) / 2).cast(peaks.schema["apex"].dataType)
        return F.struct(F.col(f"{p}.k").alias("k"), F.when((lo < apex) & (apex < hi), apex).otherwise(middle).alias("apex"), lo.alias("left_base"), hi.alias("right_base"))

    alone = F.struct("a.k", "a.apex", "a.left_base", "a.right_base")
    merged = F.struct(F.col("w.k").alias("k"), F.col("w.apex").alias("apex"), F.col("low").alias("left_base"), F.col("high").alias("right_base"))
    kept = F.when(F.col("n") == 1, F.array(alone)).when(F.col("n") == 2, F.array(part("a", 0), part("b", 2))).otherwise(F.array(merged))
    return found.select(track, F.explode(kept).alias("p")).select(track, F.col("p.k").alias(key), "p.apex", "p.left_base", "p.right_base")


def one_per_compound(peaks: DataFrame, compound: str, key: str, area: str, goodness: str, relation: str) -> DataFrame:
    """Each compound's best peak: key, compound, relation.

    The largest area, then goodness, then the first key; the first key if any
    area or goodness of the compound is null. A compound's only peak has the
    relation ``singleton``. Of compounds with one best peak the last by id stays.
    """
    rows = peaks.select(compound, F.col(key).alias("k"), F.col(relation).alias("rel"), F.col(area).alias("a"), F.col(goodness).alias("g"))
    best = rows.groupBy(compound).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("a").isNull() | F.col("g").isNull()).alias("bad"),
        F.min(F.struct((-F.col("a")).alias("a"), (-F.col("g")).alias("g"), "k", "rel")).alias("best"), F.min(F.struct("k", "rel")).alias("first"),
    )
    pick = lambda f: F.when(F.col("bad"), F.col(f"first.{f}")).otherwise(F.col(f"best.{f}"))
    chosen = best.select(pick("k").alias(key), compound, F.when(F.col("n") == 1, F.lit("singleton")).otherwise(pick("rel")).alias(relation))
    last = F.max(F.struct(compound, relation))
    return chosen.groupBy(key).agg(last.alias("x")).select(key, f"x.{compound}", f"x.{relation}")


def same_time(pairs: DataFrame, tops: DataFrame, left: str, right: str, key: str, apex: str, scans: int, share: float = 0.05, least: float = 10) -> DataFrame:
    """The pairs of tracks whose apexes (key, apex) are less than ``share`` of all scans, or ``least``, apart."""
    a, b = (tops.select(F.col(key).alias(k), F.col(apex).alias(f"__{k}")) for k in (left, right))
    return pairs.join(a, left).join(b, right).where(F.abs(F.col(f"__{left}") - F.col(f"__{right}")) < max(least, scans * share)).drop(f"__{left}", f"__{right}")


def upsert(known: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with the non-key columns of ``fresh`` where the keys match, and the rows of ``fresh`` that don't. Columns are the same; ``fresh`` has a key once."""
    others = [c for c in known.columns if c not in keys]
    new = fresh.select(*keys, F.struct(*others).alias("__f"))
    old = known.select(*keys, F.struct(*others).alias("__k"))
    both = old.join(new, keys, "full")
    return both.select(*keys, F.coalesce("__f", "__k").alias("x")).select(*keys, "x.*").select(*known.columns)


def least_height(landmarks: DataFrame, sample: str, height: str, lowest: float, height_limit: float, dynamic_range: float) -> DataFrame:
    """One row: the whole part of half the median over samples of their lowest landmark, but ``lowest`` or the limit over the dynamic range at least."""
    per = landmarks.groupBy(sample).agg(F.min(height).alias("m"))
    return per.agg(F.greatest(F.floor(F.median("m") * 0.5).cast("double"), F.lit(float(max(lowest, height_limit / dynamic_range)))).alias("least_height"))
