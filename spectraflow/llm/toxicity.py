"""Toxicity by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(theta_k - w.x)``: one weight vector shared by all
ordered thresholds. Features are the distinct lower-case words of a text and
their beginnings. Labels carry toxic 0/1 only, so grades are 0 (clean), 1 and 2
(toxic; at least the median number of toxic-evidence words for 2).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, slices_of

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows that the fit reads; everything else sees all rows."""

    sample_rows: int = 4000
    max_features: int = 4000
    min_documents: int = 6
    min_chi_square: float = 18.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    rounds: int = 300
    l1: float = 2e-4
    reject_at: float = 0.5


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (50.0, 60.0)
    prefixes: tuple[int, ...] = Settings.prefixes
    reject_at: float = 0.5

    def scores(self, texts) -> np.ndarray:
        """w.x of each text; a null text scores 0."""
        memo: dict[str, float] = {}
        known, out = self.weights, np.zeros(len(texts))
        for row, text in enumerate(texts):
            if text:
                out[row] = sum(known[f] for f in features(text, self.prefixes, known, memo))
        return out

    def expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and the most probable grade. Without features a text is clean."""
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -60, 60)))
        exceed = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
        return above.sum(axis=1), np.argmax(exceed[:, :-1] - exceed[:, 1:], axis=1)


def features(text: str, prefixes: tuple[int, ...], known=None, memo: dict | None = None) -> set[str]:
    """Distinct words (``=word``) and beginnings (``^begin``) of the whole text.

    With ``known``, only those; ``memo`` then keeps each word's hits, up to a bound.
    """
    out: set[str] = set()
    for word in set(WORD.findall(text.lower())):
        hits = memo.get(word) if memo is not None else None
        if hits is None:
            hits = ["=" + word, *("^" + word[:n] for n in prefixes if len(word) >= n)]
            if known is not None:
                hits = tuple(h for h in hits if h in known)
            if memo is not None and len(memo) < 200_000 and len(word) <= 64:  # longer words are looked up each time
                memo[word] = hits
        if hits:
            out.update(hits)
    return out


def gradients(w: np.ndarray, theta: np.ndarray, at: np.ndarray, col: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood, by weights and thresholds; row ``at[i]`` has feature ``col[i]``."""
    n = len(grade)
    s = np.bincount(at, weights=w[col], minlength=n)
    cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -60, 60)))
    edges = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
    low, high = edges[np.arange(n), grade], edges[np.arange(n), grade + 1]
    p = np.maximum(high - low, 1e-12)
    d_low, d_high = low * (1 - low) / p / n, high * (1 - high) / p / n
    # theta_k is the upper edge of grade k and the lower edge of grade k + 1; w.x shifts both the other way
    g_theta = np.array([d_low[grade == k + 1].sum() - d_high[grade == k].sum() for k in range(len(theta))])
    return np.bincount(col, weights=(d_high - d_low)[at], minlength=len(w)), g_theta


def fit(rows: list[tuple[str | None, int]], settings: Settings = Settings()) -> Model:
    """Fit on (text, toxic) rows. Without a row of either class, nothing is toxic."""
    toxic = np.array([int(t or 0) for _, t in rows], dtype=int)
    if not len(rows) or toxic.min() == toxic.max():
        return Model(prefixes=settings.prefixes, reject_at=settings.reject_at)
    in_toxic, in_clean = Counter(), Counter()
    for (text, _), t in zip(rows, toxic):
        (in_toxic if t else in_clean).update(features(text or "", settings.prefixes))
    a, b = toxic.sum(), len(toxic) - toxic.sum()
    scored = []
    for f in set(in_toxic) | set(in_clean):
        x, y = in_toxic[f], in_clean[f]
        if x + y >= settings.min_documents:
            share = (x + y) / (a + b)
            chi = ((x - a * share) ** 2) / (a * share) + ((y - b * share) ** 2) / (b * share)
            if chi >= settings.min_chi_square:
                scored.append((chi, f))
    scored.sort(key=lambda p: (-p[0], p[1]))
    names = [f for _, f in scored[: settings.max_features]]
    place = {f: i for i, f in enumerate(names)}
    found = [features(text or "", settings.prefixes, place) for text, _ in rows]  # of the chosen features only
    evidence = {f for f in names if f[0] == "=" and in_toxic[f] / a > 8 * (in_clean[f] + 0.5) / b}
    hits = np.array([sum(f in evidence for f in fs) for fs in found])
    median = max(1.0, float(np.median(hits[toxic == 1])))
    grade = np.where(toxic == 0, 0, np.where(hits >= median, 2, 1))

    pairs = [(r, place[f]) for r, fs in enumerate(found) for f in sorted(fs) if f in place]
    at, col = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    n, w, theta = len(rows), np.zeros(len(names)), np.array([2.0, 3.0])
    # proximal gradient with momentum; the step comes from a bound on the curvature, the sum of
    # the features of the fullest row times the most frequent feature's share
    per_row, per_col = np.bincount(at, minlength=n), np.bincount(col, minlength=len(names))
    step = 4 / (1 + np.sqrt(per_row.max(initial=1) * per_col.max(initial=1)) * np.sqrt(per_row.mean() + 1) / n * 4)
    ahead_w, ahead_t, t = w, theta, 1.0
    for _ in range(settings.rounds):
        g_w, g_theta = gradients(ahead_w, ahead_t, at, col, grade)
        new_w = ahead_w - step * g_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * settings.l1, 0)
        new_t = ahead_t - step * g_theta
        new_t[1] = max(new_t[1], new_t[0] + 0.05)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_t = new_w + (t - 1) / t_next * (new_w - w), new_t + (t - 1) / t_next * (new_t - theta)
        w, theta, t = new_w, new_t, t_next
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4}, tuple(float(t) for t in theta), settings.prefixes, settings.reject_at)


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``sample_rows`` labelled documents, taken in the order of a hash of doc_id."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    )
    one = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("__toxic").alias("toxic"))
    seen = {r["doc_id"]: (r["text"], r["toxic"]) for r in one.collect()}  # sample_rows at most
    return fit([seen[k] for k in sorted(seen)], settings)


def score(documents: DataFrame, model: Model, names: tuple[str, str, str] = ("severity", "grade", "toxic")) -> DataFrame:
    """Add severity double, grade int and toxic boolean, under ``names``, to every row.

    Null and empty texts are clean; equal texts get equal values; an empty table
    gives an empty one. Columns of those names are replaced, others kept.
    """
    kept = documents.drop(*names)
    schema = kept.select("*", *(F.lit(v).alias(n) for n, v in zip(names, (0.0, 0, False)))).schema
    packed = kept.sparkSession.sparkContext.broadcast(json.dumps([model.weights, model.thresholds, model.prefixes, model.reject_at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds, prefixes, reject_at = json.loads(packed.value)
        own = Model(weights, tuple(thresholds), tuple(prefixes), reject_at)
        for batch in (part for whole in batches for part in slices_of(whole)):
            severity, grade = own.expected(own.scores(batch.column("text").to_pylist()))
            yield batch_of([*batch.schema.names, *names], [*batch.columns, (severity, pa.float64()), (grade, pa.int32()), (severity >= reject_at, pa.bool_())])

    return kept.mapInArrow(run, schema)


def detect(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), **options) -> DataFrame:
    """Train, then score all documents."""
    return score(documents, train(documents, labels, settings), **options)


def clean(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows that aren't toxic, with all their columns, whatever their names."""
    names = ("__severity", "__grade", "__toxic")
    return detect(documents, labels, settings, names=names).where(~F.col("__toxic")).drop(*names)
