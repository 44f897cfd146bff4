"""Column expressions over intensity vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moving_mean(values: Column, size: int = 9) -> Column:
    """Mean of ``size`` cells around each cell; indices beyond an end repeat the end, so every window is full."""
    left, n = size // 2, F.size(values)
    cell = lambda i, k: F.element_at(values, F.greatest(F.lit(1), F.least(n, i - left + k)).cast("int"))
    window = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda acc, k: acc + cell(i, k)) / size
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), window)).otherwise(F.array().cast("array<double>"))


def area_sum(values: Column, left: Column, right: Column) -> Column:
    """Sum over the closed range of 0-based positions."""
    return F.aggregate(F.slice(values, left + 1, right - left + 1), F.lit(0.0), lambda acc, x: acc + x)


def area_auc(values: Column, left: Column, right: Column) -> Column:
    """Sum of the larger of each cell and the one before it in the range, 0 before the first; whole, as long."""
    part = F.slice(values, left + 1, right - left + 1)
    before = F.concat(F.array(F.lit(0.0)), part)
    pairs = F.zip_with(part, F.slice(before, F.lit(1), F.size(part)), lambda a, b: F.greatest(a, b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x).cast("long")


def maximum_of_two(values: Column) -> Column:
    """Each cell or the one before it, whichever is larger."""
    return F.zip_with(values, F.slice(F.concat(F.array(F.lit(0.0)), values), F.lit(1), F.size(values)), lambda a, b: F.greatest(a, b))


def first_argmax(values: Column) -> Column:
    """0-based position of the first maximum; null for an empty vector."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dense(points: Column, length: Column | int) -> Column:
    """A map scan -> intensity as a vector of ``length`` cells, 0 where absent."""
    return F.transform(F.sequence(F.lit(0), (F.lit(length) if isinstance(length, int) else length) - 1), lambda i: F.coalesce(F.element_at(points, i), F.lit(0.0)))


def top_peaks(peaks: Column, n: int) -> Column:
    """The ``n`` structs with the largest ``intensity``; earlier ones first on ties."""
    order = lambda a, b: F.when(a["intensity"] > b["intensity"], -1).when(a["intensity"] < b["intensity"], 1).otherwise(0)
    return F.slice(F.array_sort(peaks, order), 1, n)


def normalised(peaks: Column) -> Column:
    """Intensities divided by the largest."""
    most = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] / most).alias("intensity")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two aligned vectors, 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def entropy_similarity(a: Column, b: Column) -> Column:
    """1 - Jensen-Shannon divergence over ln 2 of two aligned vectors, over cells that both have, each normalised to 1."""
    both = F.filter(F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda s: (s["p"] > 0) & (s["q"] > 0))
    total = lambda cells, k: F.aggregate(cells, F.lit(0.0), lambda acc, s: acc + s[k])
    part = lambda x, m: x * F.log(x / m)

    def similarity(t: Column) -> Column:
        def cell(acc: Column, s: Column) -> Column:
            p, q = s["p"] / t["p"], s["q"] / t["q"]
            return acc + (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

        return 1 - F.aggregate(t["cells"], F.lit(0.0), cell) / F.log(F.lit(2.0))

    # bound step by step, so that cells and totals are made once
    bound = F.transform(F.array(both), lambda b: F.struct(b.alias("cells"), total(b, "p").alias("p"), total(b, "q").alias("q")))
    return F.get(F.transform(bound, lambda t: F.when(F.size(t["cells"]) == 0, F.lit(0.0)).otherwise(similarity(t))), F.lit(0))
