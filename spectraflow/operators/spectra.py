"""Spectra: peak-matching scores, library search, choice of spectra and peaks. A spectrum is an array of (mz, intensity)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraflow.operators import bands


def matches(query, reference, tolerance: float, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, reference) of all pairs of peaks at most ``tolerance`` apart, the reference moved by ``shift``."""
    return np.nonzero(np.abs(np.asarray(query, dtype=float)[:, None] - (np.asarray(reference, dtype=float) + shift)[None, :]) <= tolerance)


def matched_cosine(query, reference, tolerance: float = 0.1, least: int = 1, root: bool = True, penalty: float = 0.0, shift: float = 0.0) -> tuple[float, int]:
    """(score up to 1, matched peaks) of two lists of (mz, intensity), each scaled to its largest.

    Of all matching pairs those of the largest products are taken, each peak
    once. ``root`` weighs by square roots. Query peaks without a match count
    1 - ``penalty`` of their intensity in the length.
    """
    if not len(query) or not len(reference):
        return 0.0, 0
    (a, x), (b, y) = (np.asarray(s, dtype=float).reshape(-1, 2).T for s in (query, reference))
    if x.max() <= 0 or y.max() <= 0:
        return 0.0, 0
    x, y = x / x.max(), y / y.max()
    i, j = matches(a, b, tolerance)
    if shift:
        i2, j2 = matches(a, b, tolerance, shift)
        i, j = np.r_[i, i2], np.r_[j, j2]
    weight = np.sqrt if root else np.asarray
    product = weight(x[i]) * weight(y[j])
    dot, used_x, used_y = 0.0, np.zeros(len(x), bool), np.zeros(len(y), bool)
    for k in np.argsort(-product, kind="stable"):
        if not used_x[i[k]] and not used_y[j[k]]:
            used_x[i[k]] = used_y[j[k]] = True
            dot += product[k]
    n = int(used_x.sum())
    if n < least:
        return 0.0, n
    x = np.where(used_x, x, x * (1 - penalty))
    length = math.sqrt((weight(x) ** 2).sum() * (weight(y) ** 2).sum())
    return (min(1.0, float(dot / length)) if length > 0 else 0.0), n


def matched_entropy(query, reference, tolerance: float) -> float:
    """1 - Jensen-Shannon divergence over ln 2 of the matched peaks, each side scaled to sum 1; 0 without a match."""
    if not len(query) or not len(reference):
        return 0.0
    (a, x), (b, y) = (np.asarray(s, dtype=float).reshape(-1, 2).T for s in (query, reference))
    near = np.abs(a[:, None] - b[None, :])
    j = near.argmin(axis=1)
    hit = near[np.arange(len(a)), j] <= tolerance
    p, q = x[hit], y[j[hit]]
    if not len(p) or p.sum() <= 0 or q.sum() <= 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda s: float(np.where(s > 0, s * np.log(np.where(s > 0, s, 1.0) / m), 0.0).sum())
    return 1 - (part(p) + part(q)) / 2 / math.log(2)


def scored(pairs: DataFrame, query: str, reference: str, tolerance: float = 0.1, **options) -> DataFrame:
    """Add ``cosine``, ``n_matched`` and ``entropy`` to rows with two spectra, which are dropped. Rows are independent: no shuffle."""
    kept = pairs.drop(query, reference)
    schema = kept.select("*", F.lit(0.0).alias("cosine"), F.lit(0).alias("n_matched"), F.lit(0.0).alias("entropy")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(query).to_pylist(), batch.column(reference).to_pylist()):
                a, b = ([(p["mz"], p["intensity"]) for p in s or ()] for s in (a, b))
                found.append((*matched_cosine(a, b, tolerance, **options), matched_entropy(a, b, tolerance)))
            cosine, n, entropy = ([f[k] for f in found] for k in range(3))
            names = [c for c in batch.schema.names if c not in (query, reference)]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cosine, pa.float64()), pa.array(n, pa.int32()), pa.array(entropy, pa.float64())], names=[*names, "cosine", "n_matched", "entropy"])

    return pairs.mapInArrow(run, schema)


def _peaks(table: pa.Table, root: bool) -> dict:
    """A table's peaks as flat arrays: their row, m/z, intensity, that over the row's largest, its weight, and per row the sum of squared weights (0 without intensity)."""
    lists = pa.concat_arrays(table.column("peaks").chunks)
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    flat = lists.flatten()
    mz, raw = (np.asarray(pc.struct_field(flat, c).cast(pa.float64()), dtype=float) for c in ("mz", "intensity"))
    row, some, starts = np.repeat(np.arange(len(n)), n), np.flatnonzero(n), np.cumsum(n) - n
    top, squares = np.zeros(len(n)), np.zeros(len(n))
    if len(some):
        top[some] = np.maximum.reduceat(raw, starts[some])
    x = raw / np.where(top > 0, top, 1.0)[row]
    weight = np.sqrt(np.maximum(x, 0.0)) if root else x
    for k in np.unique(n[some]):  # rows of one length, so that sums are rounded as one spectrum's
        own = np.flatnonzero(n == k)
        squares[own] = (weight[starts[own][:, None] + np.arange(k)] ** 2).sum(axis=1)
    return {"row": row, "mz": mz, "raw": raw, "weight": weight, "squares": np.where(top > 0, squares, 0.0), "starts": starts}


def _spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``n`` from ``low``: the number of its range and its value, for every element."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


def matched_pairs(a: pa.Table, b: pa.Table, precursor: float, tolerance: float, least: float, root: bool = True, part: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of a, row of b, cosine, n_matched, entropy) of the pairs of spectra (precursor_mz, peaks) with precursors at most ``precursor`` apart and a cosine of ``least``, above 0, or more.

    As ``matched_cosine`` and ``matched_entropy``, from the matching peaks of
    all pairs at once: pairs without one score 0 and are never made. Some
    ``part`` matches, of a row of ``a`` at least, are held at a time.
    """
    p, q = _peaks(a, root), _peaks(b, root)
    x, y = (np.asarray(t.column("precursor_mz").cast(pa.float64()), dtype=float) for t in (a, b))
    if not len(p["mz"]) or not len(q["mz"]):
        return
    low = min(p["mz"].min(), q["mz"].min())
    wide = max(p["mz"].max(), q["mz"].max()) - low + 2 * tolerance + 1
    cell = lambda v: np.floor((v - min(x.min(), y.min())) / (precursor * (1 + 1e-6)))
    at = cell(y)[q["row"]] * wide + q["mz"] - low
    order = np.argsort(at, kind="stable")
    at, own = at[order], cell(x)[p["row"]] * wide + p["mz"] - low
    slack = tolerance * (1 + 1e-6) + 1e-9 * (max(abs(at[0]), abs(at[-1]), own.max()) + wide)
    first = np.stack([np.searchsorted(at, own + k * wide - slack) for k in (-1, 0, 1)], axis=1)
    n = np.stack([np.searchsorted(at, own + k * wide + slack, "right") for k in (-1, 0, 1)], axis=1) - first
    n[p["squares"][p["row"]] == 0] = 0
    total = np.concatenate([[0], np.cumsum(n.sum(axis=1))])
    ends = np.append(p["starts"][1:], len(own))  # of rows, in peaks
    row = 0
    while row < len(a):
        begin = p["starts"][row]
        row = max(row + 1, int(np.searchsorted(total[ends], total[begin] + part, "right")))
        end = ends[row - 1]
        which, j = _spread(first[begin:end].ravel(), n[begin:end].ravel())
        i, j = which // 3 + begin, order[j]
        r, s = p["row"][i], q["row"][j]
        apart = np.abs(p["mz"][i] - q["mz"][j])
        close = np.flatnonzero((apart <= tolerance) & (np.abs(x[r] - y[s]) <= precursor) & (q["squares"][s] > 0))
        i, j, apart, pair = i[close], j[close], apart[close], r[close] * len(b) + s[close]
        product = p["weight"][i] * q["weight"][j]
        best = np.lexsort((j, i, -product, pair))
        i, j, apart, pair, product = i[best], j[best], apart[best], pair[best], product[best]
        new = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.zeros(0, bool)
        pairs, number = pair[new], np.cumsum(new) - 1
        dot, taken = np.zeros(len(pairs)), np.zeros(len(pairs), np.int32)
        left = np.arange(len(pair))
        while len(left):  # of each pair's open matches the first is taken, those that share a peak with it go
            head = np.append(True, number[left][1:] != number[left][:-1])
            chosen = left[head]
            dot[number[chosen]] += product[chosen]
            taken[number[chosen]] += 1
            by = chosen[np.cumsum(head) - 1]
            left = left[(i[left] != i[by]) & (j[left] != j[by])]
        r, s = pairs // len(b), pairs % len(b)
        length = np.sqrt(p["squares"][r] * q["squares"][s])
        cosine = np.minimum(1.0, np.divide(dot, length, out=np.zeros(len(dot)), where=length > 0))
        good = cosine >= least
        held = np.flatnonzero(good[number])
        held = held[np.lexsort((j[held], apart[held], i[held], number[held]))]  # each peak's nearest match
        held = held[np.append(True, (number[held][1:] != number[held][:-1]) | (i[held][1:] != i[held][:-1]))] if len(held) else held
        at_pair = (np.cumsum(good) - 1)[number[held]]
        u, v = p["raw"][i[held]], q["raw"][j[held]]
        size = int(good.sum())
        sums = [np.bincount(at_pair, weights=w, minlength=size) for w in (u, v)]
        fit = (sums[0] > 0) & (sums[1] > 0)
        u, v = (w / np.where(fit, t, 1.0)[at_pair] for w, t in zip((u, v), sums))
        m = (u + v) / 2
        lost = sum(np.bincount(at_pair, weights=np.where(w > 0, w * np.log(np.where(w > 0, w, 1.0) / np.where(m > 0, m, 1.0)), 0.0), minlength=size) for w in (u, v))
        yield r[good], s[good], cosine[good], taken[good], np.where(fit, 1 - lost / 2 / math.log(2), 0.0)


def search_library(spectra: DataFrame, library: DataFrame, precursor: float = 0.01, tolerance: float = 0.01, least: float = 0.6, root: bool = True, **options) -> DataFrame:
    """Spectra (id, precursor_mz, peaks) against a library of the same columns: pairs with precursors at most ``precursor`` Da apart and a cosine of ``least`` or more.

    Pairs are made inside bands of precursors, from matching peaks; with a
    limit of 0, a penalty or a shift every pair is scored by itself.
    """
    if least > 0 and not any(options.values()):
        columns = ["id", F.col("precursor_mz").cast("double").alias("precursor_mz"), "peaks"]

        def run(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = [pa.concat_arrays(t.column("id").chunks) for t in (a, b)]
            for r, s, cosine, n, entropy in matched_pairs(a, b, precursor, tolerance, least, root):
                yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(r)), ids[1].take(pa.array(s)), pa.array(cosine), pa.array(n, pa.int32()), pa.array(entropy)], names=["spectrum_id", "library_id", "cosine", "n_matched", "entropy"])

        kinds = [dict(df.dtypes)["id"] for df in (spectra, library)]
        return bands.by_band(spectra.select(*columns), library.select(*columns), "precursor_mz", precursor, precursor * 16, run, f"spectrum_id {kinds[0]}, library_id {kinds[1]}, cosine double, n_matched int, entropy double")
    a = spectra.select(F.col("id").alias("spectrum_id"), F.col("precursor_mz").alias("__a"), F.col("peaks").alias("__q"))
    b = library.select(F.col("id").alias("library_id"), F.col("precursor_mz").alias("__b"), F.col("peaks").alias("__r"))
    near = bands.band_join(a, b, "__a", "__b", precursor * (1 + 1e-9), F.abs(F.col("__a") - F.col("__b")) <= precursor)
    return scored(near.select("spectrum_id", "library_id", "__q", "__r"), "__q", "__r", tolerance, root=root, **options).where(F.col("cosine") >= least)


def curated(found: DataFrame, cosine: float = 0.5, entropy: float = 0.4) -> DataFrame:
    return found.where((F.col("cosine") >= cosine) | (F.col("entropy") >= entropy))


def reverse_search(pseudo: DataFrame, library: DataFrame, index: float = 100.0, tolerance: float = 0.005, cosine: float = 0.5, entropy: float = 0.4) -> DataFrame:
    """Pseudo-spectra against library entries (both id, ri, peaks) less than ``index`` apart; both scores above their limits."""
    a = pseudo.select(F.col("id").alias("spectrum_id"), F.col("ri").alias("__a"), F.col("peaks").alias("__q"))
    b = library.select(F.col("id").alias("library_id"), F.col("ri").alias("__b"), F.col("peaks").alias("__r"))
    near = bands.band_join(a, b, "__a", "__b", index, F.abs(F.col("__a") - F.col("__b")) < index).drop("__a", "__b")
    return scored(near, "__q", "__r", tolerance).where((F.col("cosine") > cosine) & (F.col("entropy") > entropy))


def total(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda acc, p: acc + p["intensity"])


def base_peak(peaks: Column) -> Column:
    """The first peak of the largest intensity; null for none."""
    most = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    return F.get(F.filter(peaks, lambda p: p["intensity"] == most), F.lit(0))


def above_share(peaks: Column, share: float) -> Column:
    """Peaks of at least ``share`` of the largest intensity."""
    most = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    return F.filter(peaks, lambda p: p["intensity"] >= most * share)


def has_base_and_molecular(peaks: Column, base: Column, molecular: Column, da: float = 0.005) -> Column:
    """Is there a peak less than ``da`` from either mass?"""
    near = lambda m: F.exists(peaks, lambda p: F.abs(p["mz"] - m) < da)
    return near(base) & near(molecular)


def best_spectrum(spectra: DataFrame, keys: list[str], peaks: str = "peaks", order: str = "ordinal") -> DataFrame:
    """Per group the spectrum with the largest summed intensity, the first of equals."""
    by = Window.partitionBy(*keys).orderBy(F.desc(total(F.col(peaks))), order)
    return spectra.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def richest(spectra: DataFrame, keys: list[str], n: int = 5, peaks: str = "peaks", order: str = "ordinal") -> DataFrame:
    """Per group the ``n`` spectra with most peaks, earlier ones first."""
    by = Window.partitionBy(*keys).orderBy(F.desc(F.size(peaks)), order)
    return spectra.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= n).drop("__r")


def ms1_of_clusters(clusters: DataFrame, points: DataFrame, ppm_da: float, rt: float = 1.0) -> DataFrame:
    """Clusters (id, precursor_mz, rtime) with the largest MS1 intensity (mz, rtime, intensity) at most ``rt`` and less than ``ppm_da`` Da away; null without."""
    own = clusters.select("id", "precursor_mz", F.col("rtime").alias("__t"))
    near = (F.abs(F.col("precursor_mz") - F.col("mz")) < ppm_da) & (F.abs(F.col("__t") - F.col("rtime")) <= rt)
    return bands.band_join(own, points, "precursor_mz", "mz", ppm_da, near, "left").groupBy("id").agg(F.max("intensity").alias("ms1_intensity"))
