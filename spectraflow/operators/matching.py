"""Matching features of two tables, features and targets, ions or spectra; all joins are equi-joins on buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.functions import mass
from spectraflow.operators import bands
from spectraflow.operators.islands import coarse_islands
from spectraflow.operators.pairing import paired_mapping


def mz_rt_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, left_rt: str, right_rt: str, ppm: float, rt: float) -> DataFrame:
    """Pairs at most ``ppm`` of the left m/z and less than ``rt`` apart; columns must not clash and m/z is above 0.

    Buckets are of the logarithm of m/z, one tolerance wide, and of the time,
    so pairs compared grow with pairs found; the right goes to nine buckets.
    """
    width = -math.log1p(-ppm * 1e-6) * (1 + 1e-9)
    of = lambda mz, t: (F.floor(F.log(F.col(mz)) / width).cast("long"), F.floor(F.col(t) / F.lit(float(rt))).cast("long"))
    a, b = of(left_mz, left_rt), of(right_mz, right_rt)
    own = left.withColumn("__m", a[0]).withColumn("__t", a[1])
    near = F.array(*[F.struct((b[0] + i).alias("m"), (b[1] + j).alias("t")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = right.withColumn("__b", F.explode(near))
    close = (F.abs(F.col(left_mz) - F.col(right_mz)) <= F.col(left_mz) * (ppm * 1e-6)) & (F.abs(F.col(left_rt) - F.col(right_rt)) < rt)
    return own.join(other, (F.col("__m") == F.col("__b.m")) & (F.col("__t") == F.col("__b.t")) & close).drop("__m", "__t", "__b")


def compare(left: DataFrame, right: DataFrame, ppm: float = 5.0, rt: float = 5.0) -> DataFrame:
    """Mutual best pairs by m/z of tables with id, mz and rtime: left_id, right_id, ppm_error, rt_delta."""
    a, b = (t.select(F.col("id").alias(f"{s}_id"), F.col("mz").alias(f"{s}_mz"), F.col("rtime").alias(f"{s}_rt")) for t, s in ((left, "left"), (right, "right")))
    best = bands.mutual_best(mz_rt_join(a, b, "left_mz", "right_mz", "left_rt", "right_rt", ppm, rt), "left_id", "right_id", F.abs(F.col("left_mz") - F.col("right_mz")))
    return best.select("left_id", "right_id", mass.ppm_error(F.col("right_mz"), F.col("left_mz")).alias("ppm_error"), (F.col("right_rt") - F.col("left_rt")).alias("rt_delta"))


def matched_counts(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """One row: pairs, matched rows of either side, and those of either with a single partner."""
    sides = [pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias(f"{s}_matched"), F.count_if(F.col("n") == 1).alias(f"{s}_unique")) for c, s in ((left_id, "left"), (right_id, "right"))]
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(sides[0]).crossJoin(sides[1])  # one row each


def best_by_rt(pairs: DataFrame, left_id: str, right_id: str, left_rt: str, right_rt: str) -> DataFrame:
    """Each left row's partner nearest in time, then the first by id."""
    return bands.best_match(pairs, left_id, F.abs(F.col(left_rt) - F.col(right_rt)), right_id)


def extract_targets(features: DataFrame, targets: DataFrame, mz: str, target: str, target_id: str, ppm: float = 5.0, reach: float = 0.05) -> DataFrame:
    """Every target with each feature less than ``ppm`` of the target away; a target without one has nulls. ``reach``: the widest tolerance at least."""
    return bands.ppm_join(targets, features, target, mz, ppm, reach, how="left").withColumn("ppm_error", mass.ppm_error(F.col(mz), F.col(target)))


def annotate(features: DataFrame, database: DataFrame, feature_id: str, mz: str, compound: str, neutral: str, mode: str = "pos", ppm: float = 5.0, reach: float = 0.05, adducts: bool = True) -> DataFrame:
    """Features whose m/z is above an ion's by its tolerance at most, or less than that below: feature, compound, ion, ppm_error, by feature and size of the error. Buckets follow ``ppm``; ``reach`` isn't needed."""
    ions = database.select(compound, F.explode(mass.ions(F.col(neutral), mode, adducts)).alias("x")).select(compound, "x.ion", "x.ion_mz")
    limit = F.col(mz) * (ppm * 1e-6)
    inside = (F.col("ion_mz") > F.col(mz) - limit) & (F.col("ion_mz") <= F.col(mz) + limit)
    found = bands.log_band_join(features.select(feature_id, mz), ions, mz, "ion_mz", ppm, inside)
    return found.select(feature_id, compound, "ion", mass.ppm_error(F.col(mz), F.col("ion_mz")).alias("ppm_error"))


def complete_mapping(left: DataFrame, right: DataFrame, value: str, key: str, ppm: float = 5.0, reach: float = 1.0) -> DataFrame:
    """One-to-one pairs of neighbours from different lists, less than ``ppm`` of the larger apart; of two pairs that share a value the nearer, or the first, stays.

    Candidates that follow each other form a run; each is settled in its run
    from the lowest up. Only runs are gathered.
    """
    one = lambda df, n: df.select(F.col(value).cast("double").alias("v"), F.lit(n).alias("side"), F.col(key).alias("k"))
    both = coarse_islands(one(left, 1).unionByName(one(right, 2)), "v", reach)
    by = Window.partitionBy("island").orderBy("v", "side", "k")
    near = both.select("*", F.row_number().over(by).alias("at"), *[F.lag(c).over(by).alias(f"p{c}") for c in ("v", "side", "k")])
    near = near.where((F.col("side") != F.col("pside")) & (F.col("v") - F.col("pv") < F.col("v") * (ppm * 1e-6)))
    runs = near.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("island").orderBy("at")))
    lists = runs.groupBy("island", "run").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("v") - F.col("pv")).alias("d"), "v", "side", "k", "pv", "pk"))).alias("c"))

    def settle(kept: Column, c: Column) -> Column:
        last = F.element_at(kept, -1)
        free = (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["at"] < c["at"] - 1)
        return F.when(free, F.concat(kept, F.array(c))).when(c["d"] < last["d"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(c))).otherwise(kept)

    first = F.col("c.side") == 2
    pick = lambda a, b, n: F.when(first, F.col(f"c.{a}")).otherwise(F.col(f"c.{b}")).alias(n)
    kept = lists.select(F.explode(F.aggregate("c", F.slice("c", 1, 0), settle)).alias("c"))
    return kept.select(pick("pk", "k", "left_key"), pick("k", "pk", "right_key"), pick("pv", "v", "left_value"), pick("v", "pv", "right_value"))


def unmatched(rows: DataFrame, key: str, pairs: DataFrame, side: str) -> DataFrame:
    """The rows that no pair names; ``side`` is left_key or right_key."""
    return rows.join(pairs.select(F.col(side).alias(key)), key, "left_anti")


def corrected_mapping(left: DataFrame, right: DataFrame, value: str, key: str, ppm: float = 5.0, correction_ppm: float = 1.0, reach: float = 1.0) -> tuple[DataFrame, float | None]:
    """``paired_mapping`` and the mean ratio of its pairs; if that is above ``correction_ppm``, the right values are divided by 1 + ratio and paired anew."""
    pairs = paired_mapping(left, right, value, key, ppm, reach)
    ratio = pairs.agg(F.avg((F.col("right_value") - F.col("left_value")) / F.col("left_value")).alias("r")).first()["r"]  # one number
    if ratio is not None and ratio > correction_ppm * 1e-6:
        pairs = paired_mapping(left, right.withColumn(value, F.col(value) / (1 + ratio)), value, key, ppm, reach)
    return pairs, ratio


def landmark_mapping(reference: DataFrame, sample: DataFrame, ppm: float = 5.0, correction_ppm: float = 1.0, reach: float = 1.0) -> DataFrame:
    """A sample's tracks mapped to a reference grid; tables of (id, mz, landmark boolean).

    Landmarks pair first. If their pairs are more than a fifth of the reference
    and the mean ratio is beyond ``correction_ppm`` either way, the sample's m/z
    are corrected and landmarks pair anew. The others pair completely. Returns
    reference_id, sample_id and mz: the mean of a pair, a reference row's own
    without a sample, a sample row's (reference_id null) without a reference.
    """
    marks = lambda df: df.where("landmark").select("id", "mz")
    pairs = complete_mapping(marks(reference), marks(sample), "mz", "id", ppm, reach)
    seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("right_value") - F.col("left_value")) / F.col("left_value")).alias("r")).first()
    if seen["n"] > 0.2 * reference.count() and abs(seen["r"]) > correction_ppm * 1e-6:
        sample = sample.withColumn("mz", F.col("mz") / (1 + seen["r"]))
        pairs = complete_mapping(marks(reference), marks(sample), "mz", "id", ppm, reach)
    rest = complete_mapping(unmatched(reference, "id", pairs, "left_key"), unmatched(sample, "id", pairs, "right_key"), "mz", "id", ppm, reach)
    every = pairs.unionByName(rest)
    paired = every.select(F.col("left_key").alias("reference_id"), F.col("right_key").alias("sample_id"), ((F.col("left_value") + F.col("right_value")) / 2).alias("mz"))
    alone = unmatched(reference, "id", every, "left_key").select(F.col("id").alias("reference_id"), F.lit(None).cast(sample.schema["id"].dataType).alias("sample_id"), "mz")
    new = unmatched(sample, "id", every, "right_key").select(F.lit(None).cast(reference.schema["id"].dataType).alias("reference_id"), F.col("id").alias("sample_id"), "mz")
    return paired.unionByName(alone).unionByName(new)


def pairs_by_time(pairs: DataFrame, apexes: DataFrame, left: str, right: str, track: str, apex: str, scans: int, share: float = 0.05, least: int = 10) -> DataFrame:
    """The pairs of tracks whose apexes are less than ``share`` of all scans, or ``least`` scans, apart."""
    at = lambda c, n: apexes.select(F.col(track).alias(c), F.col(apex).alias(n))
    both = pairs.join(at(left, "__a"), left).join(at(right, "__b"), right)
    return both.where(F.abs(F.col("__a") - F.col("__b")) < max(least, scans * share)).drop("__a", "__b")


def spectra_of_features(features: DataFrame, spectra: DataFrame, ppm: float = 5.0, rt: float = 30.0, reach: float = 1.0) -> DataFrame:
    """Features (id, mz, rtime) with MS2 spectra (id, precursor_mz, rtime, peaks): one-to-one by precursor, then within ``rt``.

    Returns feature_id, spectrum_id and the spectrum's summed intensity as total.
    """
    total = F.aggregate("peaks", F.lit(0.0), lambda acc, p: acc + p["intensity"])
    pairs = complete_mapping(features, spectra.withColumnRenamed("precursor_mz", "mz"), "mz", "id", ppm, reach)
    a = features.select(F.col("id").alias("left_key"), F.col("rtime").alias("__a"))
    b = spectra.select(F.col("id").alias("right_key"), F.col("rtime").alias("__b"), total.alias("total"))
    both = pairs.join(a, "left_key").join(b, "right_key").where(F.abs(F.col("__a") - F.col("__b")) <= rt)
    return both.select(F.col("left_key").alias("feature_id"), F.col("right_key").alias("spectrum_id"), "total")


def best_over_files(found: DataFrame, feature: str = "feature_id", file: str = "file") -> DataFrame:
    """Per feature the spectrum with the largest total, of equals the first file's, and the number of all."""
    order = Window.partitionBy(feature).orderBy(F.desc("total"), file, "spectrum_id")
    ranked = found.withColumn("__r", F.row_number().over(order)).withColumn("matches", F.count(F.lit(1)).over(Window.partitionBy(feature)))
    return ranked.where("__r = 1").drop("__r")


def near_index(left: DataFrame, right: DataFrame, left_index: str, right_index: str, tolerance: float = 30.0) -> DataFrame:
    """Pairs with retention indices less than ``tolerance`` apart."""
    return bands.band_join(left, right, left_index, right_index, tolerance, F.abs(F.col(left_index) - F.col(right_index)) < tolerance)


def recall(compounds: DataFrame, features: DataFrame, da: float = 0.005, index: float = 30.0) -> DataFrame:
    """(compound, feature) if a feature (feature, mz, ri) is near a peak of the compound (compound, ri, peaks of mz) in m/z and index; distinct."""
    peaks = compounds.select("compound", F.col("ri").alias("__ri"), F.explode("peaks").alias("__p")).withColumn("__mz", F.col("__p.mz"))
    close = (F.abs(F.col("mz") - F.col("__mz")) < da) & (F.abs(F.col("ri") - F.col("__ri")) < index)
    return bands.band_join(peaks, features, "__mz", "mz", da, close).select("compound", "feature").distinct()


def shared_masses(query: DataFrame, library: DataFrame, mz: str) -> DataFrame:
    """The query's peaks whose m/z, rounded half to even, is one of the library's."""
    return query.join(library.select(F.bround(mz).alias("__m")).distinct(), F.bround(F.col(mz)) == F.col("__m"), "left_semi")


def nearest_track(tracks: DataFrame, targets: DataFrame, mz: str, target: str, track: str, target_id: str, reach: float = 0.1) -> DataFrame:
    """Each target's nearest track within ``reach``; of equals the smallest id."""
    return bands.nearest_within(targets, tracks, target, mz, reach, F.lit(True), target_id, track)


def in_box(points: DataFrame, scan: str, mz: str, scans: tuple[float, float], masses: tuple[float, float]) -> DataFrame:
    """Points strictly inside a box of scans and m/z."""
    return points.where((F.col(scan) > scans[0]) & (F.col(scan) < scans[1]) & (F.col(mz) > masses[0]) & (F.col(mz) < masses[1]))


def spike_ins(points: DataFrame, targets: list[tuple[str, float]], mz: str, intensity: str, da: float = 0.003, least: float = 10_000.0) -> DataFrame:
    """Points above ``least`` that lie less than ``da`` from a target of a short list, with its name."""
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("target"), F.lit(float(m)).alias("target_mz")) for n, m in targets]), lambda t: F.abs(F.col(mz) - t["target_mz"]) < da)
    return points.where(F.col(intensity) > least).withColumn("__t", F.explode(hits)).select(*points.columns, "__t.target", "__t.target_mz")


def seconds(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) * 60.0)


def minutes(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) / 60.0)
