"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time [0, 1], piecewise linear.
Its integral gives the source's share of all words; a share stops at
``max_repeats`` times the source's size and the excess goes to the others by
weight. A source's documents, in a seeded order and repeated as needed, use up
its cumulative demand; inverting that demand gives every occurrence its
training position, by which occurrences are range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.llm.common import before, materialise, seeded, text_digest, word_count


def rotating_schedule(rank: Column) -> Column:
    """Weights 1, 2, 3 by rank, repeating; in turn falling, level and rising by half around the weight."""
    weight = (1 + rank % 3).cast("double")
    tilt = ((rank % 3) - 1).cast("double") * 0.5
    return F.array(*[F.struct(F.lit(t).alias("t"), (weight * (1 + tilt * (2 * t - 1))).alias("w")) for t in (0.0, 0.5, 1.0)])


def _segments(schedule: Column) -> Column:
    """Knots to segments with the area before (f0), inside (area) and the slope."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(schedule) - 1),
        lambda i: F.struct(
            F.element_at(schedule, i)["t"].alias("t0"),
            F.element_at(schedule, i)["w"].alias("w0"),
            ((F.element_at(schedule, i + 1)["w"] - F.element_at(schedule, i)["w"]) / (F.element_at(schedule, i + 1)["t"] - F.element_at(schedule, i)["t"])).alias("slope"),
            ((F.element_at(schedule, i + 1)["w"] + F.element_at(schedule, i)["w"]) / 2 * (F.element_at(schedule, i + 1)["t"] - F.element_at(schedule, i)["t"])).alias("area"),
        ),
    )
    return pieces


def _area(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda acc, s: acc + s["area"])


def _invert(segments: Column, area: Column) -> Column:
    """The time by which a source's cumulative demand reaches ``area``."""
    start = F.struct(area.alias("left"), F.lit(0.0).alias("t"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["slope"] * acc["left"], F.lit(0.0)))
        inside = s["t0"] + F.when(acc["left"] <= 0, F.lit(0.0)).otherwise(2 * acc["left"] / (s["w0"] + root))
        here = acc["left"] <= s["area"]
        return F.when(acc["done"], acc).otherwise(
            F.struct((acc["left"] - s["area"]).alias("left"), F.when(here, inside).otherwise(F.lit(1.0)).alias("t"), here.alias("done"))
        )

    return F.aggregate(segments, start, step)["t"]


def source_targets(sizes: DataFrame, schedule=rotating_schedule, max_repeats: int = 3) -> DataFrame:
    """One row per source: source_size, target and the schedule's segments.

    Sources are ranked by code point, null last. With level L, a source's target
    is the lesser of its cap and L times its weight; L is the largest of the
    levels that follow from capping the k sources with the least cap per weight.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")  # a row per source
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__rank", F.row_number().over(every) - 1)
    table = table.withColumn("segments", _segments(schedule(F.col("__rank")))).withColumn("__weight", _area(F.col("segments")))
    table = table.withColumn("__cap", F.col("source_size") * max_repeats)
    by_cap = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("__weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("__level", level)
    target = F.least(F.col("__cap").cast("double"), F.max("__level").over(Window.partitionBy()) * F.col("__weight"))
    return table.select("source", "source_size", target.alias("target"), "segments")


def sized(documents: DataFrame, carried: list, seed: str) -> DataFrame:
    """What a plan needs of each row (doc_id, source, size and its place in the seeded order) and the columns ``carried``."""
    digest, fraction = seeded(seed, F.col("doc_id"), text_digest(F.col("text")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    return documents.select(*carried, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("__key"), digest.alias("__digest"), fraction.alias("__fraction"))


def planned(rows: DataFrame, schedule=rotating_schedule, max_repeats: int = 3, slices: int = 256, whole: bool = False) -> DataFrame:
    """Rows of ``sized`` with source_size, target, taken and ``occurrences``; see ``plan``."""
    targets = source_targets(rows.select("source", "size"), schedule, max_repeats)
    targets = targets.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    placed = before(rows, ["__key"], ["__digest", "doc_id"], F.col("__fraction"), slices, F.col("size")).join(targets, "__key")

    words = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    left = words - passes * F.col("source_size") - F.col("__before")
    last = F.greatest(F.least(F.col("size"), left), F.lit(0))
    if whole:
        last = F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    placed = placed.withColumn("__words", words).withColumn("__passes", passes.cast("int")).withColumn("__last", last.cast("long"))
    placed = placed.withColumn("taken", F.col("size") * F.col("__passes") + F.col("__last"))
    count = F.col("__passes") + (F.col("__last") > 0).cast("int")
    area = _area(F.col("segments"))

    def occurrence(e: Column) -> Column:
        taken = F.when(e < F.col("__passes"), F.col("size")).otherwise(F.col("__last"))
        done = (e * F.col("source_size") + F.col("__before") + taken / 2) / F.greatest(F.col("__words"), F.lit(1))
        return F.struct(e.alias("epoch"), taken.alias("words"), _invert(F.col("segments"), F.least(done, F.lit(1.0)) * area).alias("position"))

    listed = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), occurrence)).otherwise(F.array().cast("array<struct<epoch:int,words:bigint,position:double>>"))
    return placed.withColumn("occurrences", listed)


ADDED = ("size", "source_size", "target", "taken", "occurrences")


def plan(documents: DataFrame, seed: str = "mix", columns: list[str] | None = None, **options) -> DataFrame:
    """One row per input row, with its columns (all, or ``columns``), size, source_size, target, taken and ``occurrences``.

    An occurrence has epoch, words and position. A source takes its rounded
    target exactly: full passes, then one over its first documents, whose last
    is cut; with ``whole`` that one is taken or left whole, whichever is nearer.
    The seeded order goes by doc_id and text, so only equal rows can't be told
    apart. Null and empty texts have size 0 and one occurrence per full pass; a
    source without words has target 0. Repeated rows count each; an empty table
    gives an empty one; columns of the added names are replaced, others kept
    whatever their names. With ``columns`` texts are read once, and only what
    was named and the sizes are written and planned on.
    """
    kept = [c for c in (documents.columns if columns is None else columns) if c not in ADDED]
    rows = sized(documents, [F.struct(*kept).alias("__row")], seed)
    if columns is not None:
        rows = materialise(rows, "mix-sizes")
    return planned(rows, **options).select("__row.*", *ADDED)


def mix(documents: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """All columns of the input, whatever their names, once per occurrence, range-sorted by training position. Documents are taken whole."""
    rows = sized(documents, [F.struct(*documents.columns).alias("__row")], seed)
    every = planned(rows, whole=True, **options).withColumn("__o", F.explode("occurrences"))
    ordered = every.repartitionByRange(F.col("__o.position"), "__digest", "__o.epoch").sortWithinPartitions("__o.position", "__digest", "__o.epoch")
    return ordered.select("__row.*")
