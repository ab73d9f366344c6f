"""Packing, resampling and clustering against plain Python, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import clusters, importance, packing, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, piece string, length int, rank string, score int, ids string, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, a null key, and clashing names."""
    long = " ".join(f"w{i}" for i in range(9_000))
    many = "alpha beta gamma delta " * 8
    texts = [None, "", " \n\t", "one", "one", "It's 12 O'clock!", long, long + " end of it", "é É ß 日本\x0bx", "x" * 5000, many, many, "a<|endoftext|>b"]
    rows = [(i, t, "p", 1, "r", 2, "i", 3) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, many, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where(F.lit(False))


# Packing


@cache
def tokenizer():
    return Tokenizer.from_file(packing.Settings().tokenizer)


def plain_ids(text):
    found = tokenizer().encode(text or "", add_special_tokens=False).ids
    return [*found, 0]


def test_ids_of_words_and_runs_are_those_of_the_text():
    odd = ["J̌Á á.b", "it's 'S x'll ''re-do!!A'd", "a\x1cb\x1d c", "<|endoftext|> A<|ENDOFTEXT|>b <|startoftext|>", "ͅa ẞSS ΑΣ. Σ", "12ab34,.;x9", "x́'S", "naïve-Test"]
    odd += [f"A{c}b{c}" for c in map(chr, range(0x110000)) if c.isspace()]
    rng = random.Random(9)
    odd += ["".join(rng.choice("aB'.<|>1 ́é\n\x1fſİΣ日") for _ in range(60)) for _ in range(300)]
    letters = [chr(c) for c in range(0x180)] + [chr(c) for c in range(0x2010, 0x205F)] + ["'s", "'ll", "'", " "]
    odd += ["".join(rng.choice(letters) for _ in range(50)) for _ in range(2000)] + [f"a{c}b {c} 'S{c}x'" for c in letters]
    words = packing.Words(packing.Settings(segment=25, known_words=40))
    for text, found in zip(odd, words.ids(odd), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain_ids(text)[:-1], repr(text)


def test_known_words_cost_less_than_splitting_by_a_pattern():
    text = " ".join(f"{a}{b}{mark}" for a in ("The", "été", "under") for b in ("ing", "schön", "ed") for mark in ("", ",", "-x", "'s")) * 30_000
    words = packing.Words(packing.Settings())
    words.ids([text[:1000]])
    pattern, took = re.compile(r"[^\W\d_]+|\d|[^\w\s]+"), {}
    for name, run in (("pattern", lambda: pattern.findall(text)), ("words", lambda: list(packing.id_lists(words, pa.array([text]))))):
        times = []
        for _ in range(3):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        took[name] = min(times)
    assert took["words"] < 0.8 * took["pattern"]


def test_a_character_of_another_script_leaves_other_words_parted():
    words = packing.Words(packing.Settings())
    text = "a-b 日-a Été, b\x00 <|endoftext|>b B-A"
    assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == plain_ids(text)[:-1]
    assert {"a", "-", "b", "été", ","} <= set(words.known) and not {"a-b", "b-a", "B-A"} & set(words.known)


def check_packed(rows, docs, capacity):
    """Every document whole, in pieces; every sequence gapless and no longer than the capacity."""
    held, docs_seen = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] <= 4 * capacity
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        docs_seen[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter((key, tuple(ids[i : i + capacity]), i // capacity, i) for key, ids in docs for i in range(0, len(ids), capacity))
    assert Counter((key, tuple(ids), piece, start) for key, found in docs_seen.items() for piece, start, ids in found) == want
    return len(held)


def first_fit_count(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        at = next((i for i, left in enumerate(room) if left >= length), None)
        if at is None:
            room.append(capacity - length)
        else:
            room[at] -= length
    return len(room)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_odd_rows(odd, none, capacity):
    s = packing.Settings(capacity=capacity, segment=1000, known_words=50)
    rows = packing.placed(packing.pieces(odd, settings=s), capacity).collect()
    docs = [(r["doc_id"], plain_ids(r["text"])) for r in odd.select("doc_id", "text").collect()]
    found = check_packed(rows, docs, capacity)
    assert found <= first_fit_count([r["length"] for r in rows], capacity)
    empty = packing.placed(packing.pieces(none))
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"] and empty.count() == 0


def test_packing_of_documents(spark, folder):
    docs = queries.table(spark, folder, "documents")
    pieces = packing.pieces(docs)
    placed = packing.placed(pieces)
    rows = placed.collect()
    ids = [(r["doc_id"], plain_ids(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert check_packed(rows, ids, 2048) <= first_fit_count([r["length"] for r in rows], 2048)
    got = {(r["doc_id"], r["piece"]): r for r in queries.op11_packing(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        other = got[r["doc_id"], r["piece"]]
        assert other["ids_crc32"] == zlib.crc32(r["ids"])
        assert all(other[c] == r[c] for c in ("start", "length", "sequence_id", "offset"))
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=30), st.integers(30, 40))
def test_plan_places_every_piece_once(counts, capacity):
    made = packing.plan(counts, capacity)
    filled, placed = defaultdict(set), Counter()
    ends = defaultdict(list)
    for length, rank, sequence, per, offset in made.runs:
        ends[length].append(rank)
    for length, rank, sequence, per, offset in made.runs:
        later = [r for r in ends[length] if r > rank]
        for i in range(rank, min(later, default=counts[length])):
            at = offset + (i - rank) % per * length
            spots = set(range(at, at + length))
            there = filled[sequence + (i - rank) // per]
            assert not there & spots and at + length <= capacity
            there |= spots
            placed[length] += 1
    assert placed == Counter(counts)
    assert set(filled) == set(range(made.sequences))
    assert all(there == set(range(len(there))) for there in filled.values())


def most_pairs(lengths, capacity):
    """The largest number of pairs that fit, by trying everything."""
    if len(lengths) < 2:
        return 0
    first, rest = lengths[0], lengths[1:]
    return max([most_pairs(rest, capacity)] + [1 + most_pairs(rest[:i] + rest[i + 1 :], capacity) for i in range(len(rest)) if first + rest[i] <= capacity])


def test_large_pieces_pair_as_often_as_they_can():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(11, 30) for _ in range(rng.randint(1, 9))]
        assert packing.plan(Counter(lengths), 30).sequences == len(lengths) - most_pairs(lengths, 30)


# Resampling


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(g.encode()) % 10000 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_resample(docs, target):
    all_docs, all_target = Counter(), Counter()
    for _, text in docs:
        all_docs.update(plain_features(text)[1])
    for text in target:
        all_target.update(plain_features(text)[1])
    big, small = sum(all_docs.values()), sum(all_target.values())
    gain = [math.floor(1000 * math.log((all_target[b] + 1) * (big + 10000) / ((all_docs[b] + 1) * (small + 10000)))) for b in range(10000)]
    rows = []
    for key, text in docs:
        w, f = plain_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * 25 // 100
    ranked = [(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return sorted(ranked + [(*r, None) for r in rows if r[1] < 20], key=repr)


def test_resampling_odd_rows(spark, odd, none):
    target = queries.table(spark, "/root/testdata/sf0.001", "benchmark")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_resample(docs, [r["text"] for r in target.collect()])
    found = importance.resample(odd, target)
    assert found.columns == ["doc_id", "text", "piece", "length", "ids", "part", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == want
    assert importance.resample(none, target).count() == 0
    assert importance.resample(odd, target.where("false"), keep=[]).where("rank is not null").count() == sum(r[5] is not None for r in want)


def test_drawn_in_order_over_many_ranges(spark):
    docs = [(i % 990, f"{'the cat ' * 10} {i % 7}") for i in range(1000)]
    target = ["the cat sat", None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(13)
    found = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), keep=["doc_id"])
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_resample(docs, target)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_features_of_long_texts_in_parts(words):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abÉé1") for _ in range(rng.randint(1, 9))) for _ in range(900)) + " " + "long" * 700 + " -- x"
    s = importance.Settings(words=words)
    w = WORD.findall(text.translate(LOWER))
    want = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, words + 1) for i in range(len(w) - n + 1))
    for most in (50, 333, 1 << 20):
        got, n_words = Counter(), 0
        for first, data, at, carried in importance.parts(pa.array(["a", text, None]), words - 1, most):
            rows, buckets, word_rows = importance.features(data, at, carried, s)
            got.update(buckets[rows + first == 1].tolist())
            n_words += int((word_rows + first == 1).sum())
        assert got == want and n_words == len(w)


def test_crcs_of_any_length():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    starts, lengths = rng.integers(0, 3000, 300), rng.integers(0, 40, 300)
    lengths[:3] = [3000, 1024, 1025]
    assert importance.crcs(data, starts, lengths).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]


# Clustering


def plain_clusters(rows, k, rounds, dim):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    found = [(key, *nearest(v)[::-1]) for key, v in kept]
    total = Counter()
    for _, cluster, d in found:
        total[cluster] += d
    most = 2**63 - 1
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((key, c, min(d, most), min(total[c], most), min(sum(total.values()), most), mark[c]) for key, c, d in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, id int, v int"


def frame_of(spark, rows):
    return spark.createDataFrame([(key, v, "c", "d", 1, 2) for key, v in rows], VECTORS)


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_of_odd_vectors(spark, wide):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [float("nan")] * 4), (105, [float("inf")] * 4)]
    rows += [rows[3], rows[3], (106, rows[3][1]), (None, [0.5] * 4), (107, [0.0] * 4), (108, [-0.0] * 4)]
    if wide:
        rows += [(200, [1e9] * 4), (201, [-3e38, 3e38, 1.0, 0.0]), (202, [1e9, 1e9, 1e9, -1e9])]
    rows = [(key, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for key, v in rows]
    s = clusters.Settings(clusters=9, rounds=3, dim=4, cells=64)
    got = clusters.clustered(frame_of(spark, rows), settings=s)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows, 9, 3, 4)


def test_few_or_no_vectors(spark):
    rows = [(i, [1.0 * i] * 4) for i in range(3)]
    s = clusters.Settings(dim=4)
    assert sorted((tuple(r) for r in clusters.clustered(frame_of(spark, rows), settings=s).collect()), key=repr) == plain_clusters(rows, 40, 5, 4)
    empty = clusters.clustered(frame_of(spark, rows).where("false"), settings=s)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_tree_finds_nearest_with_ties(points, dim, spread, seed):
    rng = np.random.default_rng(seed)
    held, asked = rng.integers(-spread, spread + 1, (points, dim)), rng.integers(-spread, spread + 1, (50, dim))
    number, square = clusters.Tree(held, 2).nearest(asked)
    far = ((asked[:, None] - held) ** 2).sum(axis=2)
    assert number.tolist() == far.argmin(axis=1).tolist() and square.tolist() == far.min(axis=1).tolist()
