"""Peaks judged against the noise of their track: audit, regions of interest, shape, selectivity and signal to noise.

Everything here works on one track's intensity vector; ``evaluated`` runs it
over a table of tracks, whose rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.operators import peaks

# The largest intensity that isn't scaled down; scans that part regions, by which short ones grow, and
# that two peaks may share; how many noise cells each side count, and how many next to the apex don't.
HIGHEST, GAP, GROWTH, SHARED, FLANK, PADDING = 1e8, 3, 3, 3, 100, 30


@dataclass(frozen=True)
class Limits:
    """What counts as a peak."""

    low: float = 1000.0
    height: float = 100000.0
    ratio: float = 0.001
    prominence: float = 33000.0
    prominence_ratio: float = 0.02
    timepoints: int = 6
    wlen: int = 25
    snr: float = 2.0
    shape: float = 0.5

    @property
    def fwhm(self) -> int:
        return round(0.5 * self.timepoints)


@dataclass(frozen=True)
class Audit:
    """A cleaned track: ``values`` over its ``baseline``, divided by ``scale``, and the height a peak needs there."""

    values: np.ndarray
    baseline: float
    noise: float
    scale: float
    height: float


def smoothed(v: np.ndarray, size: int) -> np.ndarray:
    """Mean of ``size`` cells around each, the ends repeated."""
    left = size // 2
    return np.convolve(np.pad(v, (left, size - 1 - left), mode="edge"), np.full(size, 1.0 / size), mode="valid")


def audit(values, limits: Limits, whole: bool = False) -> Audit:
    """Scale, detrend, smooth and lower a track as its own statistics ask; ``whole`` numbers stay whole where they are smoothed.

    Baseline and noise are the mean and the population deviation of the values
    less than ``low`` above the lower quartile, ``low`` at least.
    """
    v, low = np.asarray(values, dtype=float), limits.low
    top = float(v.max())
    scale = max(1.0, top / HIGHEST)
    if scale > 1:
        v, whole = v / scale, False
    baseline = noise = low
    middle = float(np.median(v))
    if middle > low:
        if (v > low).mean() > 0.5 and middle > 10 * limits.height:
            x = np.arange(len(v)) - (len(v) - 1) / 2
            v, whole = v - v.mean() - x * (x @ v) / (x @ x), False
        quiet = v[v < np.quantile(v, 0.25) + low]
        baseline, noise = max(low, float(quiet.mean())), max(low, float(quiet.std()))
    steep = scale > 1 or top > 1000 * limits.height
    faint = top < 10 * limits.height or top < 100 * noise
    if steep or faint:
        v = smoothed(v, 3 * limits.fwhm if steep else limits.fwhm + 2)
        v = np.trunc(np.round(v, 9)) if whole else v
    return Audit(v - baseline, baseline, noise, scale, max(limits.height, top * limits.ratio) - baseline)


def regions(v: np.ndarray, noise: float, fwhm: int) -> list[tuple[int, int]]:
    """First and last scans of the runs above ``noise`` that are less than ``GAP`` apart inside; ones too short go, short ones grow."""
    at = np.flatnonzero(v > noise)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) >= GAP)
    bounds = zip(at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]])
    kept = [(int(a), int(b)) for a, b in bounds if b - a + 1 >= fwhm + 2]
    return [(max(0, a - GROWTH), min(len(v) - 1, b + GROWTH)) if b - a + 1 < 3 * fwhm else (a, b) for a, b in kept]


def shaped(part: np.ndarray, start: int, found: dict, limits: Limits) -> dict | None:
    """A maximum of a region as a peak with its whole area and height; None where a Gaussian doesn't describe it."""
    apex, left, right = found["apex"], found["left_base"], found["right_base"]
    x = np.arange(left, right + 1)
    fit = peaks.fit_gaussian(x, part[x], (found["height"], float(apex), max(0.5, found["width"] / 2.355)))
    good = peaks.goodness(part[x], peaks.gaussian(x, *fit)) if fit and fit[2] else 0.0
    if not good > limits.shape:
        return None
    reach = int(6 * max(fit[2], limits.fwhm))
    left, right = max(left, apex - reach), min(right, apex + reach)
    return {
        "apex": start + apex, "left_base": start + left, "right_base": start + right,
        "height": int(found["height"]), "area": int(part[left : right + 1].sum()), "goodness": good,
    }


def in_region(part: np.ndarray, start: int, track: Audit, limits: Limits) -> list[dict]:
    """Peaks of a region without overlaps; the window for bases is given up where it finds none in a longer region."""
    least = max(limits.prominence, limits.prominence_ratio * float(part.max()), 0.33 * track.height, 2 * track.noise)
    look = lambda window: peaks.find_peaks(part, track.height, limits.fwhm, least, limits.fwhm, window)
    found = look(limits.wlen) or (look(None) if len(part) > limits.wlen else [])
    wide = [p for p in found if p["right_base"] - p["left_base"] >= limits.fwhm + 2]
    return apart([p for p in (shaped(part, start, p, limits) for p in wide) if p])


def shared(first: dict, second: dict) -> int:
    """Scans that two peaks share, by the end of whichever ends first."""
    ends, other = (first, second) if second["right_base"] > first["right_base"] else (second, first)
    return ends["right_base"] - other["left_base"]


def apart(found: list[dict]) -> list[dict]:
    """Chains of overlapping peaks made disjoint: two share out their sorted bases, of more the widest takes the whole range."""
    chains: list[list[dict]] = []
    for p in found:
        if chains and shared(chains[-1][-1], p) > SHARED:
            chains[-1].append(p)
        else:
            chains.append([p])
    return [p for chain in chains for p in parted(chain)]


def parted(chain: list[dict]) -> list[dict]:
    if len(chain) == 1:
        return chain
    bases = sorted(p[side] for p in chain for side in ("left_base", "right_base"))
    if len(chain) > 2:
        return [max(chain, key=lambda p: p["right_base"] - p["left_base"]) | {"left_base": bases[0], "right_base": bases[-1]}]
    halves = zip(sorted(chain, key=lambda p: p["apex"]), (bases[:2], bases[2:]))
    return [p | {"left_base": a, "right_base": b, "apex": p["apex"] if a < p["apex"] < b else (a + b) // 2} for p, (a, b) in halves]


def covered(found: list[dict], n: int) -> np.ndarray:
    """Mask of the scans inside any peak."""
    mask = np.zeros(n, dtype=bool)
    for p in found:
        mask[p["left_base"] : p["right_base"] + 1] = True
    return mask


def selectivity(v: np.ndarray, inside: np.ndarray, height: float) -> float:
    """Share of the cells above half of ``height`` that lie in peaks."""
    high = v > 0.5 * height
    return float((high & inside).sum() / high.sum()) if (high & inside).any() else 0.0


def flank_noise(values: np.ndarray, inside: np.ndarray, apex: int, limits: Limits, otherwise: float) -> float:
    """Mean, plus one, of the noise cells on both sides of an apex, ``low`` at least; ``otherwise`` where there are none.

    The window of a side is counted in noise cells; left of the first cells it
    wraps around as slices with negative bounds do.
    """
    cells = np.sort(np.append(np.flatnonzero(~inside), apex))
    at = int(np.searchsorted(cells, apex))
    use = np.r_[cells[at - PADDING - FLANK : at - PADDING], cells[at + PADDING : at + PADDING + FLANK]]
    return max(limits.low, float((values[use] + 1).mean())) if len(use) else otherwise


def judged(values, limits: Limits, whole: bool = False) -> list[dict]:
    """The peaks of one track whose height is ``snr`` times their local noise or more; positions from 0."""
    raw = np.nan_to_num(np.asarray(values, dtype=float))
    if not len(raw) or not raw.max() > limits.low:
        return []
    track = audit(raw, limits, whole)
    found = [p for a, b in regions(track.values, track.noise, limits.fwhm) for p in in_region(track.values[a : b + 1], a, track, limits)]
    inside, kept = covered(found, len(raw)), []
    for p in found:
        height = track.scale * p["height"] + track.baseline
        snr = int(height / flank_noise(raw, inside, p["apex"], limits, track.noise))
        if snr >= limits.snr:
            kept.append(p | {"height": int(height), "selectivity": selectivity(track.values, inside, p["height"]), "snr": snr})
    return kept


JUDGED = "apex int, left_base int, right_base int, height long, area long, goodness double, selectivity double, snr long"


def evaluated(tracks: DataFrame, track: str, values: str, limits: Limits = Limits()) -> DataFrame:
    """One row per peak of each track, a row with its whole vector: track and the columns of ``JUDGED``.

    There is no shuffle, and a task holds one batch of vectors. Null and empty
    vectors, and those that never rise above ``low``, have no peaks.
    """
    kind, cell = tracks.schema[track].dataType.simpleString(), tracks.schema[values].dataType.elementType.typeName()
    names, whole = [c.split()[0] for c in JUDGED.split(", ")], cell in ("byte", "short", "integer", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[key, *(p[c] for c in names)] for key, v in zip(batch["k"], batch["v"]) if v is not None for p in judged(v, limits, whole)]
            yield pd.DataFrame(found, columns=["k", *names])

    some = F.coalesce(F.exists(F.col(values), lambda x: x > limits.low), F.lit(False))
    rows = tracks.where(some).select(F.col(track).cast("string").alias("k"), F.col(values).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"k string, {JUDGED}").withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", track)
