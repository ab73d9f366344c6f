"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text is read as words, in overlapping windows that cover all of it. Each word
enters the network by a word part (a hashed embedding and the class log-odds of
the word) and a character part (the mean hashed embedding of its byte 4-grams
and the largest class log-odds among them). Two gated recurrent layers, one per
direction, run over a window; an attention layer weighs their states and a
logistic unit scores the weighted sum. The score of a text is that of its
highest-scoring window.

Log-odds are counted by Spark over all training rows, into a fixed number of
hash buckets. The network is trained in numpy on the driver with a bounded sample
of training rows (``sample_docs`` rows of each class, ``sample_bytes`` of text each).
A logistic curve over texts held back from that sample, of any length and weighted to
the classes' true sizes, makes probabilities of the logits, so a cut means the same at any size of the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .batches import add_columns
from .labelled import bucket_counts, held_back, sample

WORD_BUCKETS = 1 << 18
CHAR_BUCKETS = 1 << 18
EMBEDDED_WORDS = 1 << 15
EMBEDDED_CHARS = 1 << 13
GRAM = 4
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 24
    hidden: int = 8
    word_width: int = 6
    char_width: int = 6
    rounds: int = 3
    epochs: int = 2
    least_steps: int = 400
    rate: float = 0.01
    sample_docs: int = 1500
    sample_bytes: int = 20_000
    curve_docs: int = 750  # texts of each class that are held back for the curve, about, and at most a fifth
    seed: int = 17


@dataclass
class Model:
    settings: Settings
    word_odds: np.ndarray
    char_odds: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (WORD_BUCKETS - 1)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte 4-grams of each word (a shorter word is one gram), and where each word's begin."""
    lengths = ends - starts
    count = np.maximum(lengths - GRAM + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(int(count.sum())) - np.repeat(first - starts, count)
    limit = np.repeat(ends, count)
    value = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        here = at + i
        letter = tokens._LOWER[data[np.minimum(here, len(data) - 1)]].astype(np.uint64) + _ONE
        value = value * np.uint64(257) + np.where(here < limit, letter, np.uint64(0))
    return tokens.mix(value), first


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a batch for counting: word buckets, then character buckets."""
    rows, buckets = [], []
    for first, data, at in tokens.blocks(texts):
        starts, ends, row = tokens.word_bounds(data, at)
        if not len(starts):
            continue
        hashes = tokens.word_hashes(data, starts, ends)
        grams, begin = _grams(data, starts, ends)
        gram_rows = np.repeat(row, np.diff(np.r_[begin, len(grams)]))
        pairs = np.concatenate([
            row * (WORD_BUCKETS + CHAR_BUCKETS) + _word_buckets(hashes),
            gram_rows * (WORD_BUCKETS + CHAR_BUCKETS) + WORD_BUCKETS + (grams & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64),
        ])
        pairs = np.unique(pairs)
        rows.append(pairs // (WORD_BUCKETS + CHAR_BUCKETS) + first)
        buckets.append(pairs % (WORD_BUCKETS + CHAR_BUCKETS))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _odds(ones: np.ndarray, zeros: np.ndarray, n_ones: float, n_zeros: float) -> np.ndarray:
    ones, zeros = np.maximum(ones, 0), np.maximum(zeros, 0)
    made = np.log((ones + 0.5) / (n_ones + 1)) - np.log((zeros + 0.5) / (n_zeros + 1))
    made = np.where(ones + zeros < 0.5, 0, made)
    return np.clip(made / 2, -3, 3).astype(np.float32)


def _inputs(weights: dict, word: np.ndarray, word_odds: np.ndarray, grams: np.ndarray, begin: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    count = np.diff(np.r_[begin, len(grams)]).astype(np.float32)
    chars = np.add.reduceat(weights["char"][grams], begin, axis=0) / count[:, None]
    return np.concatenate([weights["word"][word], word_odds[:, None], chars, np.maximum.reduceat(gram_odds, begin)[:, None]], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _scan(projected: np.ndarray, mask: np.ndarray, u: np.ndarray, b: np.ndarray, kept: list | None) -> np.ndarray:
    """States of one direction; ``projected`` is time x batch x 3 hidden, ``kept`` collects what training needs."""
    steps, batch, width = projected.shape
    n = width // 3
    state = np.zeros((batch, n), np.float32)
    out = np.empty((steps, batch, n), np.float32)
    for t in range(steps):
        inner = state @ u
        gates = _sigmoid(projected[t, :, : 2 * n] + inner[:, : 2 * n])
        update, reset = gates[:, :n], gates[:, n:]
        rest = inner[:, 2 * n :] + b
        new = np.tanh(projected[t, :, 2 * n :] + reset * rest)
        step = update * mask[t][:, None]
        if kept is not None:
            kept.append((state, update, reset, rest, new, mask[t]))
        state = state + step * (new - state)
        out[t] = state
    return out


def _unscan(back: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs, of ``u`` and of ``b`` from those of the states."""
    steps, batch, n = back.shape
    into, du, db = np.zeros((steps, batch, 3 * n), np.float32), np.zeros_like(u), np.zeros(n, np.float32)
    carry = np.zeros((batch, n), np.float32)
    for t in range(steps - 1, -1, -1):
        state, update, reset, rest, new, mask = kept[t]
        carry = carry + back[t]
        m = mask[:, None]
        d_update = carry * (new - state) * m * update * (1 - update)
        d_new = carry * update * m * (1 - new * new)
        d_reset = d_new * rest * reset * (1 - reset)
        d_rest = d_new * reset
        inner = np.concatenate([d_update, d_reset, d_rest], axis=1)
        into[t] = np.concatenate([d_update, d_reset, d_new], axis=1)
        du += state.T @ inner
        db += d_rest.sum(0)
        carry = carry * (1 - update * m) + inner @ u.T
    return into, du, db


def _attend(weights: dict, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray):
    states = np.concatenate([forward, backward], axis=2)
    weight = states @ weights["attend"]
    weight = np.where(mask > 0, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return states, weight, pooled, pooled @ weights["out"] + weights["bias"][0]


def _windows(row: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of the overlapping windows of a block's words."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(row)])
    count = 1 + np.maximum(0, -(-(size - window) // stride))
    base = np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    offset = (np.arange(int(count.sum())) - base) * stride
    return np.repeat(first, count) + offset, np.minimum(np.repeat(size, count) - offset, window), np.repeat(row[first], count)


def _window_logits(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit, row and first word of every window of a block."""
    s, w = model.settings, model.weights
    hashes = tokens.word_hashes(data, starts, ends)
    _, pick, back = np.unique(hashes, return_index=True, return_inverse=True)
    grams, begin = _grams(data, starts[pick], ends[pick])
    x = _inputs(
        w, (hashes[pick] & np.uint64(EMBEDDED_WORDS - 1)).astype(np.int64), model.word_odds[_word_buckets(hashes[pick])],
        (grams >> np.uint64(32)).astype(np.int64) & (EMBEDDED_CHARS - 1), begin, model.char_odds[(grams & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64)],
    )
    ahead, behind = x @ w["ahead_w"] + w["ahead_c"], x @ w["behind_w"] + w["behind_c"]
    first, length, rows = _windows(row, s.window, s.stride)
    logits = np.empty(len(first), np.float32)
    steps = np.arange(s.window)[:, None]
    for i in range(0, len(first), 2048):
        f, n = first[i : i + 2048], length[i : i + 2048]
        inside = steps < n
        word = back[np.minimum(f + steps, len(back) - 1)]
        mask = inside.astype(np.float32)
        forward = _scan(ahead[word], mask, w["ahead_u"], w["ahead_b"], None)
        backward = _scan(behind[word[::-1]], mask[::-1], w["behind_u"], w["behind_b"], None)[::-1]
        logits[i : i + 2048] = _attend(w, forward, backward, mask)[3]
    return logits, rows, first


def _logits(model: Model, texts: pa.Array) -> np.ndarray:
    """The logit of each text: that of its highest window; a text without words has the logit of no evidence."""
    out = np.full(len(texts), -30.0 if not model.weights else float(model.weights["prior"][0]), np.float32)
    for first, data, at in tokens.blocks(texts) if model.weights else ():
        starts, ends, row = tokens.word_bounds(data, at)
        if len(starts):
            logits, rows, _ = _window_logits(model, data, starts, ends, row)
            begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[rows[begin] + first] = np.maximum.reduceat(logits, begin)
    return out.astype(np.float64)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text: the curve's value at its logit."""
    return 1 / (1 + np.exp(-np.clip(model.slope * _logits(model, texts) + model.offset, -30, 30)))


def _start(s: Settings, random: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape, by):
        return (random.standard_normal(shape) * by).astype(np.float32)

    n, width = s.hidden, s.word_width + s.char_width + 2
    made = {"word": normal(EMBEDDED_WORDS, s.word_width, by=0.05), "char": normal(EMBEDDED_CHARS, s.char_width, by=0.05)}
    for side in ("ahead", "behind"):
        made |= {
            f"{side}_w": normal(width, 3 * n, by=width**-0.5),
            f"{side}_c": np.zeros(3 * n, np.float32),
            f"{side}_u": normal(n, 3 * n, by=n**-0.5),
            f"{side}_b": np.zeros(n, np.float32),
        }
    return made | {"attend": normal(2 * n, by=0.1), "out": normal(2 * n, by=0.3), "bias": np.zeros(1, np.float32)}


def _step(weights: dict, batch: dict, targets: np.ndarray, window: int) -> dict:
    """Gradients of the mean log loss over a batch of windows."""
    kept_a, kept_b = [], []
    x, mask = batch["x"], batch["mask"]
    forward = _scan(x @ weights["ahead_w"] + weights["ahead_c"], mask, weights["ahead_u"], weights["ahead_b"], kept_a)
    backward = _scan((x @ weights["behind_w"] + weights["behind_c"])[::-1], mask[::-1], weights["behind_u"], weights["behind_b"], kept_b)[::-1]
    states, weight, pooled, logit = _attend(weights, forward, backward, mask)
    error = ((_sigmoid(logit) - targets) / len(targets)).astype(np.float32)
    d_pooled = error[:, None] * weights["out"]
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * weights["attend"]
    n = forward.shape[2]
    into_a, ua, ba = _unscan(d_states[:, :, :n], kept_a, weights["ahead_u"])
    into_b, ub, bb = _unscan(d_states[::-1, :, n:], kept_b, weights["behind_u"])
    into_b = into_b[::-1]
    flat = x.reshape(-1, x.shape[2])
    return {
        "out": pooled.T @ error, "bias": error.sum(keepdims=True), "attend": np.einsum("tb,tbh->h", d_score, states),
        "ahead_w": flat.T @ into_a.reshape(len(flat), -1), "ahead_c": into_a.sum((0, 1)), "ahead_u": ua, "ahead_b": ba,
        "behind_w": flat.T @ into_b.reshape(len(flat), -1), "behind_c": into_b.sum((0, 1)), "behind_u": ub, "behind_b": bb,
        "x": into_a @ weights["ahead_w"].T + into_b @ weights["behind_w"].T,
    }


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def apply(self, weights: dict, grads: dict) -> None:
        self.n += 1
        for name, g in grads.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
            weights[name] = (weights[name] - self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-7)).astype(np.float32)


def _train(model: Model, texts: list[str], labels: np.ndarray, counts: tuple[np.ndarray, np.ndarray], sizes: tuple[float, float]) -> None:
    s = model.settings
    random = np.random.default_rng(s.seed)
    weights = _start(s, random)
    model.weights = weights
    zeros, ones = counts
    # A training text's own words are taken out of the counts, else rare words would tell its label.
    left = [
        (_odds(ones - y, zeros - (1 - y), sizes[1] - y, sizes[0] - (1 - y))) for y in (0, 1)
    ]
    docs = []
    for first, data, at in tokens.blocks(pa.array(texts, pa.large_string()), most=1 << 18):
        starts, ends, row = tokens.word_bounds(data, at)
        if not len(starts):
            continue
        begin_window, length, rows = _windows(row, s.window, s.stride)
        hashes = tokens.word_hashes(data, starts, ends)
        grams, begin = _grams(data, starts, ends)
        y = labels[row + first]
        word_odds = np.where(y > 0, left[1][:WORD_BUCKETS][_word_buckets(hashes)], left[0][:WORD_BUCKETS][_word_buckets(hashes)])
        bucket = (grams & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64)
        gram_y = np.repeat(y, np.diff(np.r_[begin, len(grams)]))
        gram_odds = np.where(gram_y > 0, left[1][WORD_BUCKETS:][bucket], left[0][WORD_BUCKETS:][bucket])
        docs.append((hashes, word_odds, grams, begin, gram_odds, begin_window, length, rows + first))
    if not docs:
        model.weights = {}
        return

    def batch_of(picked: list[tuple[int, int]]) -> dict:
        """Inputs of windows given as (block, window)."""
        size = len(picked)
        mask = np.zeros((s.window, size), np.float32)
        x = np.zeros((s.window, size, s.word_width + s.char_width + 2), np.float32)
        words, gram_list = [], []
        for j, (block, i) in enumerate(picked):
            hashes, word_odds, grams, begin, gram_odds, first, length, _ = docs[block]
            a, n = first[i], length[i]
            stop = begin[a + n] if a + n < len(begin) else len(grams)
            part = grams[begin[a] : stop]
            local = begin[a : a + n] - begin[a]
            word = (hashes[a : a + n] & np.uint64(EMBEDDED_WORDS - 1)).astype(np.int64)
            chars = (part >> np.uint64(32)).astype(np.int64) & (EMBEDDED_CHARS - 1)
            x[:n, j] = _inputs(weights, word, word_odds[a : a + n], chars, local, gram_odds[begin[a] : stop])
            mask[:n, j] = 1
            words.append(word)
            gram_list.append((chars, local))
        return {"x": x, "mask": mask, "words": words, "grams": gram_list}

    def logits_of(block: int) -> np.ndarray:
        hashes, word_odds, grams, begin, gram_odds, first, length, _ = docs[block]
        x = _inputs(weights, (hashes & np.uint64(EMBEDDED_WORDS - 1)).astype(np.int64), word_odds, (grams >> np.uint64(32)).astype(np.int64) & (EMBEDDED_CHARS - 1), begin, gram_odds)
        steps = np.arange(s.window)[:, None]
        mask = (steps < length).astype(np.float32)
        at = np.minimum(first + steps, len(x) - 1)
        forward = _scan((x @ weights["ahead_w"] + weights["ahead_c"])[at], mask, weights["ahead_u"], weights["ahead_b"], None)
        backward = _scan((x @ weights["behind_w"] + weights["behind_c"])[at[::-1]], mask[::-1], weights["behind_u"], weights["behind_b"], None)[::-1]
        return _attend(weights, forward, backward, mask)[3]

    adam = _Adam(s.rate)
    for turn in range(s.rounds):
        chosen = []
        for block, (_, word_odds, _, begin, gram_odds, first, length, rows) in enumerate(docs):
            if turn:
                value = logits_of(block)
            else:
                evidence = np.maximum(word_odds, 0) ** 2 + np.maximum(np.maximum.reduceat(gram_odds, begin), 0) ** 2
                total = np.concatenate([[0], np.cumsum(evidence)])
                value = total[first + length] - total[first]
            order = np.lexsort((-value, rows))
            top = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
            chosen += [(block, i) for i in top]
            extra = random.integers(0, len(first), max(1, len(top) // 4))
            chosen += [(block, i) for i in extra if labels[rows[i]] == 0]
        for _ in range(max(s.epochs, -(-s.least_steps * 64 // (s.rounds * len(chosen))))):
            order = random.permutation(len(chosen))
            for i in range(0, len(order), 64):
                picked = [chosen[j] for j in order[i : i + 64]]
                batch = batch_of(picked)
                y = np.array([labels[docs[b][7][w]] for b, w in picked], np.float32)
                grads = _step(weights, batch, y, s.window)
                dx = grads.pop("x")
                adam.apply(weights, grads)
                d = 0.5 * dx.transpose(1, 0, 2)[batch["mask"].T > 0]  # in the order of the batch's words
                np.subtract.at(weights["word"], np.concatenate(batch["words"]), d[:, : s.word_width])
                count = np.concatenate([np.diff(np.r_[local, len(chars)]) for chars, local in batch["grams"]])
                share = d[:, s.word_width + 1 : -1] / count[:, None]
                np.subtract.at(weights["char"], np.concatenate([chars for chars, _ in batch["grams"]]), np.repeat(share, count, axis=0))
        adam.rate *= 0.6
    # A text without any word has no evidence: the smallest logit of a training text.
    weights["prior"] = np.array([min(float(logits_of(b).min()) for b in range(min(8, len(docs))))], np.float32)


def _set_curve(model: Model, held: DataFrame, trained: list[int], counts: tuple[np.ndarray, np.ndarray], sizes: tuple[float, float]) -> None:
    """Slope and offset by the logits of the held-back texts, which are taken by the executors.

    The ridge draws to slope 1 and to the offset that corrects the trained mix of classes, for tables with few texts to hold back.
    """
    zeros, ones = counts
    margins, labels, weights = [], [], []
    for y in (0, 1):
        # as in training, a text's own words are taken out of the counts
        odds = _odds(ones - y, zeros - (1 - y), sizes[1] - y, sizes[0] - (1 - y))
        without = Model(model.settings, odds[:WORD_BUCKETS], odds[WORD_BUCKETS:], model.weights)

        def compute(texts: pa.Array, without: Model = without) -> list[pa.Array]:
            return [pa.array(_logits(without, texts), pa.float64())]

        found = add_columns(held.where(F.col("label") == y), "text", [("logit", T.DoubleType())], compute, ["label"]).select("logit").toArrow()["logit"].to_numpy()
        margins.append(found)
        labels.append(np.full(len(found), float(y)))
        weights.append(np.full(len(found), sizes[y] / max(len(found), 1)))
    x, target, weight = np.concatenate(margins), np.concatenate(labels), np.concatenate(weights)
    n_ones = sum(trained)
    shift = float(np.log(sizes[1] / sizes[0]) - np.log(max(n_ones, 1) / max(len(trained) - n_ones, 1)))
    model.slope, model.offset = 1.0, shift
    if not (len(margins[0]) and len(margins[1])):
        return
    weight /= weight.mean()
    design, start, ridge = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, shift]), np.diag([1.0, 0.1])

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float(weight @ (np.logaddexp(0, z) - target * z) + 0.5 * (beta - start) @ ridge @ (beta - start))

    beta = start.copy()
    for _ in range(100):
        p = _sigmoid(design @ beta)
        gradient = design.T @ (weight * (target - p)) - ridge @ (beta - start)
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:  # logits far out make full steps too long
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] > 0:
        model.slope, model.offset = float(beta[0]), float(beta[1])


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model of rows with a 0/1 label. Rows without label or text do not count; without rows of both classes every score is 0."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(key).alias("key"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isin(0, 1))
    counts, sizes = bucket_counts(rows, text_features, WORD_BUCKETS + CHAR_BUCKETS)
    odds = _odds(counts[1], counts[0], sizes[1], sizes[0])
    model = Model(settings, odds[:WORD_BUCKETS], odds[WORD_BUCKETS:])
    if min(sizes) > 0:
        back = held_back(sizes, settings.curve_docs)
        texts, labels = sample(rows.where(~back), settings.sample_docs, settings.sample_bytes)
        _train(model, texts, np.array(labels), counts, sizes)
        if model.weights:
            _set_curve(model, rows.where(back), labels, counts, sizes)
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1, in column ``out``.

    Null and empty texts, and texts without words, get the score of no evidence.
    Equal texts get the same score up to the rounding
    of 32-bit sums (1e-6), which depends on the batch. A column already named ``out`` is replaced; other
    columns (or those in ``keep``) stay as they are. An empty table stays empty.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:  # the model it carries has a fixed number of weights
        return [pa.array(scores(model, texts), pa.float64())]

    return add_columns(df, text, [(out, T.DoubleType())], compute, keep)
