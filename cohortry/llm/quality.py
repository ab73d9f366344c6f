"""Quality scores by a support vector machine on Naive Bayes features.

Features are indicators of n-grams: of words (one and two), and of word forms (one
to three), where the form of a word is its case, the signs that follow it, and
whether it repeats the word before. They are hashed into a fixed number of
buckets. Each indicator is scaled by its class log-count ratio, rows are brought
to unit length, and a linear model with squared hinge loss is fitted by dual
coordinate descent. A logistic curve, fitted by fivefold cross-validation, turns margins into scores.

The counts behind the ratios cover all training rows; the linear model is fitted on
the driver with at most ``sample_docs`` rows of each class of ``sample_bytes`` each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .batches import add_columns
from .labelled import bucket_counts, sample

BUCKETS = 1 << 18


@dataclass(frozen=True)
class Settings:
    cost: float = 1.0
    passes: int = 12
    sample_docs: int = 3000
    sample_bytes: int = 40_000
    seed: int = 5


@dataclass
class Model:
    weights: np.ndarray  # linear weight times log-count ratio of each bucket
    slope: float = 0.0
    offset: float = -30.0


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of the form of each word."""
    first, second = data[starts], data[np.minimum(starts + 1, ends - 1)]
    upper = (first >= 65) & (first <= 90)
    form = upper.astype(np.uint64) + np.uint64(2) * (upper & (second >= 65) & (second <= 90) & (ends - starts > 1)).astype(np.uint64)
    form += np.uint64(4) * ((first >= 48) & (first <= 57)).astype(np.uint64)
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]
    form += np.uint64(8) * again.astype(np.uint64)
    after = np.r_[starts[1:], len(data)]
    for i in range(3):
        at = ends + i
        form = form * np.uint64(257) + np.where(at < after, data[np.minimum(at, len(data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return tokens.mix(form)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a batch, ordered."""
    rows, buckets = [], []
    for first, data, at in tokens.blocks(texts, 1 << 19):
        starts, ends, row = tokens.word_bounds(data, at)
        if not len(starts):
            continue
        words = tokens.word_hashes(data, starts, ends)
        forms = _forms(data, starts, ends, row, words)
        found = []
        for salt, (values, n) in enumerate(((words, 1), (words, 2), (forms, 1), (forms, 2), (forms, 3))):
            if len(values) < n:
                continue
            grams = tokens.salted(tokens.runs(values, n), salt)
            same = row[: len(grams)] == row[n - 1 :]
            found.append(row[: len(grams)][same] * BUCKETS + (grams[same] & np.uint64(BUCKETS - 1)).astype(np.int64))
        pairs = np.unique(np.concatenate(found))
        rows.append(pairs // BUCKETS + first)
        buckets.append(pairs % BUCKETS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _ratios(ones: np.ndarray, zeros: np.ndarray, n_ones: float, n_zeros: float) -> np.ndarray:
    return np.log((np.maximum(ones, 0) + 1) / (n_ones + 2)) - np.log((np.maximum(zeros, 0) + 1) / (n_zeros + 2))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of the squared hinge loss by dual coordinate descent."""
    weights, alpha = np.zeros(BUCKETS), np.zeros(len(rows))
    extra = 0.5 / s.cost
    norms = np.array([float(v @ v) for _, v in rows]) + extra
    random = np.random.default_rng(s.seed)
    for _ in range(s.passes):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, value = rows[i]
            slope = signs[i] * float(weights[at] @ value) - 1 + extra * alpha[i]
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * signs[i] * value
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def _curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a small ridge."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (labels - p)) - 1e-2 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _margins(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    row, bucket = text_features(texts)
    size = np.bincount(row, minlength=len(texts))
    return np.bincount(row, weights[bucket], len(texts)) / np.sqrt(np.maximum(size, 1))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * _margins(model.weights, texts) + model.offset, -30, 30)))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model of rows with a 0/1 label. Rows without label or text do not count; without rows of both classes every score is 0."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(key).alias("key"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isin(0, 1))
    (zeros, ones), (n_zeros, n_ones) = bucket_counts(rows, text_features, BUCKETS)
    if min(n_zeros, n_ones) == 0:
        return Model(np.zeros(BUCKETS))
    texts, kinds = sample(rows, settings.sample_docs, settings.sample_bytes)
    labels = np.array(kinds)
    ratios = _ratios(ones, zeros, n_ones, n_zeros)
    # A training row's own n-grams are taken out of the counts, else rare ones would tell its label.
    without = [_ratios(ones - y, zeros - (1 - y), n_ones - y, n_zeros - (1 - y)) for y in (0, 1)]
    row, bucket = text_features(pa.array(texts, pa.large_string()))
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    made = []
    for i, y in enumerate(labels):
        at = bucket[cut[i] : cut[i + 1]]
        made.append((at, without[y][at] / np.sqrt(max(len(at), 1))))
    signs = np.where(labels == 1, 1.0, -1.0)
    weights = _descend(made, signs, settings)
    margins = np.array([float(weights[at] @ value) for at, value in made])
    # The curve is fitted to margins of weights that did not see the row: those of the other four fifths.
    if min((labels == 1).sum(), (labels == 0).sum()) > 1:
        fold = np.arange(len(made)) % 5  # rows are in the order of their labels, so each part has both
        for part in range(5):
            used, back = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
            others = _descend([made[i] for i in used], signs[used], settings)
            margins[back] = [float(others[made[i][0]] @ made[i][1]) for i in back]
    share = np.where(labels == 1, n_ones / max((labels == 1).sum(), 1), n_zeros / max((labels == 0).sum(), 1))
    slope, offset = _curve(margins, labels.astype(float), share / share.mean())
    return Model(weights * ratios, slope, offset)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1, in column ``out``.

    Null and empty texts, and texts without words, have no features: their score is
    the curve's at margin 0. Equal texts get equal scores. A column already named
    ``out`` is replaced; other columns (or those in ``keep``) stay as they are. An
    empty table stays empty.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:  # the model it carries has a fixed number of weights
        return [pa.array(scores(model, texts), pa.float64())]

    return add_columns(df, text, [(out, T.DoubleType())], compute, keep)
