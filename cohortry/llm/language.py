"""Language of texts by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes that cover all of it. Filters
of several widths slide over the bytes of a window, each keeps its largest
response, and a softmax layer turns these into language probabilities. A text's
probabilities are the softmax of its windows' mean log-probabilities, each window
weighted by its bytes that are not blank.

The network is trained in numpy on the driver, with at most ``sample_docs`` texts of
each language of ``sample_bytes`` each, and ``sample_windows`` windows of a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .batches import add_columns
from .labelled import sample

_LETTER = re.compile(r"[^\W\d_]")
#: The label of texts without a letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    window: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 6
    epochs: int = 6
    rate: float = 0.01
    sample_docs: int = 500
    sample_bytes: int = 40_000
    sample_windows: int = 5
    seed: int = 3


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _cut(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a block's rows, padded with zeros, and the row of each."""
    size = np.diff(at)
    count = -(-size // window)
    row = np.repeat(np.arange(len(size)), count)
    offset = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
    begin, left = at[row] + offset, size[row] - offset
    spot = np.arange(window)
    made = tokens._LOWER[data[np.minimum(begin[:, None] + spot, max(len(data) - 1, 0))]] if len(data) else np.zeros((0, window), np.uint8)
    made[spot >= left[:, None]] = 0
    return made, row


def _tables(weights: dict, widths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each width and place in the filter, the share of every byte in the filter's response."""
    return [[weights["bytes"] @ weights[f"filter{w}"][k] for k in range(w)] for w in widths]


def _respond(windows: np.ndarray, tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Responses of each width: windows x places x filters."""
    out = []
    for places in tables:
        n = windows.shape[1] - len(places) + 1
        total = places[0][windows[:, :n]]
        for k in range(1, len(places)):
            total += places[k][windows[:, k : k + n]]
        out.append(total)
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """Row by row the probability of each language."""
    s, w = model.settings, model.weights
    total = np.zeros((len(texts), len(model.languages)))
    weight = np.zeros(len(texts))
    tables = _tables(w, s.widths)
    for first, data, at in tokens.blocks(texts):
        windows, row = _cut(data, at, s.window)
        for i in range(0, len(windows), 64):  # small enough to stay in cache
            part = windows[i : i + 64]
            pooled = np.concatenate([r.max(axis=1) for r in _respond(part, tables)], axis=1)
            logs = _log_softmax(np.maximum(pooled + w["bias"], 0) @ w["out"] + w["out_bias"])
            share = (part > 32).sum(axis=1)
            np.add.at(total, row[i : i + 64] + first, logs * share[:, None])
            np.add.at(weight, row[i : i + 64] + first, share)
    return np.exp(_log_softmax(total / np.maximum(weight, 1)[:, None]))


def _train(model: Model, windows: np.ndarray, labels: np.ndarray) -> None:
    s = model.settings
    random = np.random.default_rng(s.seed)

    def normal(*shape, by):
        return (random.standard_normal(shape) * by).astype(np.float32)

    w = model.weights
    w["bytes"] = normal(256, s.embedding, by=0.5)
    w["bytes"][0] = 0
    for width in s.widths:
        w[f"filter{width}"] = normal(width, s.embedding, s.filters, by=(width * s.embedding) ** -0.5)
    w["bias"] = np.zeros(len(s.widths) * s.filters, np.float32)
    w["out"] = normal(len(s.widths) * s.filters, len(model.languages), by=0.2)
    w["out_bias"] = np.zeros(len(model.languages), np.float32)
    m, v, n = {}, {}, 0
    for epoch in range(s.epochs):
        order = random.permutation(len(windows))
        for i in range(0, len(order), 64):
            x, y = windows[order[i : i + 64]], labels[order[i : i + 64]]
            responses = _respond(x, _tables(w, s.widths))
            places = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([r.max(axis=1) for r in responses], axis=1) + w["bias"]
            active = np.maximum(pooled, 0)
            error = np.exp(_log_softmax(active @ w["out"] + w["out_bias"]))
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ w["out"].T) * (pooled > 0)
            grads = {"out": active.T @ error, "out_bias": error.sum(0), "bias": back.sum(0), "bytes": np.zeros_like(w["bytes"])}
            for j, width in enumerate(s.widths):
                d = back[:, j * s.filters : (j + 1) * s.filters]
                grads[f"filter{width}"] = np.zeros_like(w[f"filter{width}"])
                for k in range(width):
                    seen = np.take_along_axis(x, places[j] + k, axis=1)  # the byte under this place at the largest response
                    grads[f"filter{width}"][k] = np.einsum("bfe,bf->ef", w["bytes"][seen], d)
                    np.add.at(grads["bytes"], seen, d[:, :, None] * w[f"filter{width}"][k].T)
            grads["bytes"][0] = 0
            n += 1
            for name, g in grads.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                rate = s.rate * 0.7**epoch
                w[name] = (w[name] - rate * (m[name] / (1 - 0.9**n)) / (np.sqrt(v[name] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model of the languages in column ``label``; rows without label, or whose text is null or blank, do not count."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(key).alias("key"))
    rows = rows.where(F.col("label").isNotNull() & (F.octet_length(F.trim("text")) > 0))
    texts, labels = sample(rows, settings.sample_docs, settings.sample_bytes)
    model = Model(settings, sorted(set(labels)))
    index = {name: i for i, name in enumerate(model.languages)}
    random = np.random.default_rng(settings.seed)
    windows, kinds = [], []
    for first, data, at in tokens.blocks(pa.array(texts, pa.large_string())):
        cut, row = _cut(data, at, settings.window)
        # some windows of each text, in random order
        order = np.lexsort((random.random(len(row)), row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        chosen = order[place < settings.sample_windows]
        windows.append(cut[chosen])
        kinds.append(np.array([index[labels[i]] for i in row[chosen] + first]))
    if windows:
        _train(model, np.concatenate(windows), np.concatenate(kinds))
    return model


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the language of each whole text in ``out`` and its probability in ``score``.

    A text that is null or has no letter is ``und`` with score 0; so is every text if the
    model saw no language. Equal texts get equal results. Columns already named ``out`` or ``score``
    are replaced; other columns (or those in ``keep``) stay as they are. An empty table stays empty.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:  # the model it carries has a fixed number of weights
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
        if not model.languages or not len(texts):
            return [pa.array([UNDETERMINED] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        found = probabilities(model, texts)
        best = found.argmax(axis=1)
        names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, lettered, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(lettered, np.minimum(found.max(axis=1), 1.0), 0.0))]

    return add_columns(df, text, [(out, T.StringType()), (score, T.DoubleType())], compute, keep)
