"""The trained models against slow versions in plain Python: forward passes, gradients and the optimum."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa

from cohortry.llm import language, quality, tokens, toxicity

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["The quick brown fox", "", None, "a", "Ünïcode ß and 12 numbers, " * 30, "one two three four five " * 40, "x" * 700, "end. Of, line\n\n!"]


def softmax(values):
    top = max(values)
    parts = [math.exp(v - top) for v in values]
    return [p / sum(parts) for p in parts]


def dot(a, b):
    return sum(float(x) * float(y) for x, y in zip(a, b, strict=True))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


# Language: filters over bytes


def plain_language(model, window):
    """Log-probabilities of one padded window of bytes."""
    w, s = model.weights, model.settings
    hidden = []
    for width in s.widths:
        for f in range(s.filters):
            responses = [
                sum(dot(w["bytes"][window[place + k]], w[f"filter{width}"][k][:, f]) for k in range(width)) for place in range(len(window) - width + 1)
            ]
            hidden.append(max(0.0, max(responses) + float(w["bias"][len(hidden)])))
    return [math.log(p) for p in softmax([dot(hidden, w["out"][:, j]) + float(w["out_bias"][j]) for j in range(len(model.languages))])]


def windows_of(text, size):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [data[i : i + size].ljust(size, b"\0") for i in range(0, len(data), size)]


def random_language(seed, epochs, n):
    s = language.Settings(window=24, widths=(2, 3), filters=3, embedding=4, epochs=epochs, seed=seed)
    model = language.Model(s, ["aa", "bb", "cc"])
    rng = np.random.default_rng(seed)
    windows = rng.integers(32, 127, (n, s.window)).astype(np.uint8)
    windows[:, 20:] = 0
    labels = rng.integers(0, 3, n)
    language._train(model, windows, labels)
    return model, windows, labels


def test_language_forward():
    model, _, _ = random_language(1, 1, 50)
    found = language.probabilities(model, pa.array(TEXTS))
    for text, row in zip(TEXTS, found, strict=True):
        total, weight = [0.0] * 3, 0
        for window in windows_of(text, model.settings.window):
            share = sum(b > 32 for b in window)
            total = [t + share * v for t, v in zip(total, plain_language(model, window), strict=True)]
            weight += share
        assert np.allclose(row, softmax([t / max(weight, 1) for t in total]), atol=1e-5)


def test_language_step_goes_down_the_slope():
    """The first training step moves every weight against the sign of its numeric gradient."""
    before, windows, labels = random_language(2, 0, 12)
    after, _, _ = random_language(2, 1, 12)

    def loss():
        return -sum(plain_language(before, window)[y] for window, y in zip(windows.tolist(), labels, strict=True)) / len(labels)

    rng, checked = random.Random(2), 0
    for name, weights in before.weights.items():
        spots = [i for i in np.ndindex(weights.shape) if after.weights[name][i] != weights[i]]
        for at in rng.sample(spots, min(6, len(spots))):
            kept, slopes = weights[at], []
            for gap in (1e-3, 5e-4):
                weights[at] = kept + gap
                up = loss()
                weights[at] = kept - gap
                slopes.append((up - loss()) / (2 * gap))
                weights[at] = kept
            if abs(slopes[0]) > 2e-3 and abs(slopes[0] - slopes[1]) < 0.1 * abs(slopes[0]):  # not at a kink of the largest response
                assert np.sign(after.weights[name][at] - kept) == -np.sign(slopes[0]), (name, at)
                checked += 1
    assert checked >= 15


# Toxicity: gated recurrent network with attention


def plain_gru(inputs, w, side):
    """States over a list of input vectors, first to last."""
    n = w["attend"].shape[0] // 2
    state, out = [0.0] * n, []
    for x in inputs:
        projected = [dot(x, w[f"{side}_w"][:, j]) + float(w[f"{side}_c"][j]) for j in range(3 * n)]
        inner = [dot(state, w[f"{side}_u"][:, j]) for j in range(3 * n)]
        update = [sigmoid(projected[j] + inner[j]) for j in range(n)]
        reset = [sigmoid(projected[n + j] + inner[n + j]) for j in range(n)]
        new = [math.tanh(projected[2 * n + j] + reset[j] * (inner[2 * n + j] + float(w[f"{side}_b"][j]))) for j in range(n)]
        state = [(1 - u) * old + u * fresh for u, old, fresh in zip(update, state, new, strict=True)]
        out.append(state)
    return out


def plain_window(inputs, w):
    ahead, behind = plain_gru(inputs, w, "ahead"), plain_gru(inputs[::-1], w, "behind")[::-1]
    states = [a + b for a, b in zip(ahead, behind, strict=True)]
    weight = softmax([dot(state, w["attend"]) for state in states])
    pooled = [sum(a * state[j] for a, state in zip(weight, states, strict=True)) for j in range(len(states[0]))]
    return dot(pooled, w["out"]) + float(w["bias"][0])


def random_toxicity(seed):
    s = toxicity.Settings(window=6, stride=4, hidden=3, word_width=3, char_width=2)
    rng = np.random.default_rng(seed)
    odds = [(rng.standard_normal(n) * 0.5).astype(np.float32) for n in (toxicity.WORD_BUCKETS, toxicity.CHAR_BUCKETS)]
    model = toxicity.Model(s, *odds, toxicity._start(s, rng))
    for name in ("ahead_c", "ahead_b", "behind_c", "behind_b", "bias"):
        model.weights[name] = (rng.standard_normal(model.weights[name].shape) * 0.3).astype(np.float32)
    model.weights["prior"] = np.array([-1.5], np.float32)
    return model


def plain_input(model, word):
    """Word and character inputs of one word of UTF-8 bytes."""
    data = np.frombuffer(word, np.uint8)
    number = int(tokens.word_hashes(data, np.array([0]), np.array([len(data)]))[0])
    lowered = [b + 32 if 65 <= b <= 90 else b for b in word]
    grams = []
    for i in range(max(1, len(lowered) - toxicity.GRAM + 1)):
        value = 0
        for k in range(toxicity.GRAM):
            value = (value * 257 + (lowered[i + k] + 1 if i + k < len(lowered) else 0)) % 2**64
        grams.append(int(tokens.mix(np.array([value], np.uint64))[0]))
    w = model.weights
    chars = [w["char"][(g >> 32) % toxicity.EMBEDDED_CHARS] for g in grams]
    mean = [sum(float(c[j]) for c in chars) / len(chars) for j in range(w["char"].shape[1])]
    most = max(float(model.char_odds[g % toxicity.CHAR_BUCKETS]) for g in grams)
    return [*w["word"][number % toxicity.EMBEDDED_WORDS], model.word_odds[(number >> 20) % toxicity.WORD_BUCKETS], *mean, most]


def test_toxicity_forward():
    model = random_toxicity(3)
    found = toxicity._logits(model, pa.array(TEXTS))
    s = model.settings
    for text, logit in zip(TEXTS, found, strict=True):
        inputs = [plain_input(model, word) for word in WORD.findall((text or "").encode().lower())]
        spots = [0]
        while spots[-1] + s.window < len(inputs):
            spots.append(spots[-1] + s.stride)
        want = max(plain_window(inputs[i : i + s.window], model.weights) for i in spots) if inputs else -1.5
        assert abs(logit - want) < 1e-4, text


def test_toxicity_gradients():
    model = random_toxicity(4)
    rng = np.random.default_rng(4)
    width = model.settings.word_width + model.settings.char_width + 2
    lengths = [6, 3, 1, 5]
    x = rng.standard_normal((6, len(lengths), width)).astype(np.float32)
    mask = (np.arange(6)[:, None] < np.array(lengths)).astype(np.float32)
    targets = np.array([1.0, 0.0, 1.0, 0.0])
    grads = toxicity._step(model.weights, {"x": x, "mask": mask}, targets, 6)

    def loss():
        total = 0.0
        for j, (n, y) in enumerate(zip(lengths, targets, strict=True)):
            p = sigmoid(plain_window([x[t, j] for t in range(n)], model.weights))
            total -= y * math.log(p) + (1 - y) * math.log(1 - p)
        return total / len(lengths)

    pick = random.Random(4)
    for name, grad in grads.items():
        values = x if name == "x" else model.weights[name]
        for at in pick.sample(list(np.ndindex(values.shape)), min(8, values.size)):
            kept = values[at]
            values[at] = kept + np.float32(1e-2)
            up, high = loss(), float(values[at])
            values[at] = kept - np.float32(1e-2)
            slope = (up - loss()) / (high - float(values[at]))
            values[at] = kept
            assert abs(slope - float(grad[at])) < 2e-4 + 0.01 * abs(slope), (name, at)


# Quality: log-count ratios and squared hinge loss


def test_quality_descent_reaches_the_optimum():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(30, 8, replace=False))
        rows.append((at, rng.standard_normal(8)))
    signs = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    s = quality.Settings(passes=5000, cost=0.7)
    weights = quality._descend(rows, signs, s)
    slope = weights.copy()
    for (at, value), sign in zip(rows, signs, strict=True):
        margin = sum(float(weights[a]) * float(v) for a, v in zip(at, value, strict=True))
        for a, v in zip(at, value, strict=True):
            slope[a] -= 2 * s.cost * max(0.0, 1 - sign * margin) * sign * v
    # the gradient of half the squared weights plus cost times squared hinge losses
    assert np.abs(slope).max() < 0.05 * np.abs(weights).max()  # the descent ends when no dual weight moves by 0.001


def test_quality_model_by_hand(spark):
    rng = random.Random(8)
    good, bad = ["river stone light", "quiet garden wall"], ["BUY NOW!!!", "click $$$ here"]
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(4)), i % 2) for i in range(60)]
    model = quality.fit(spark.createDataFrame(docs, "doc_id int, text string, label int"))
    found = quality.scores(model, pa.array([text for _, text, _ in docs]))
    counts = {0: {}, 1: {}}
    seen = []
    for _, text, label in docs:
        buckets = quality.text_features(pa.array([text]))[1].tolist()
        assert len(buckets) == len(set(buckets))
        seen.append(buckets)
        for bucket in buckets:
            counts[label][bucket] = counts[label].get(bucket, 0) + 1
    for buckets, score, (_, _, label) in zip(seen, found, docs, strict=True):
        margin = sum(float(model.weights[b]) for b in buckets) / math.sqrt(len(buckets))
        assert abs(score - sigmoid(model.slope * margin + model.offset)) < 1e-9
        assert (score >= 0.3) == (label == 1)
    for bucket in set(counts[0]) | set(counts[1]):
        ratio = math.log((counts[1].get(bucket, 0) + 1) / 32) - math.log((counts[0].get(bucket, 0) + 1) / 32)
        # a weight is the fitted one times the ratio, so a feature that tells nothing weighs nothing
        assert (abs(ratio) < 1e-12) <= (abs(model.weights[bucket]) < 1e-9)
        made = quality._ratios(np.array([counts[1].get(bucket, 0)]), np.array([counts[0].get(bucket, 0)]), 30, 30)[0]
        assert abs(made - ratio) < 1e-12


def test_every_sampled_row_has_a_say_in_the_quality_weights(spark):
    docs = [(i, f"good words here own{i}" if i % 3 else f"bad bad text own{i}", int(i % 3 > 0)) for i in range(60)]
    model = quality.fit(spark.createDataFrame(docs, "doc_id int, text string, label int"))
    without = [set(quality.text_features(pa.array([text.replace(f" own{i}", "")]))[1].tolist()) for i, text, _ in docs]
    shared = set().union(*without)
    for i, text, _ in docs:
        own = set(quality.text_features(pa.array([f"own{i}"]))[1].tolist()) - shared
        assert own and np.abs(model.weights[list(own)]).max() > 0, text
