"""The text operators against plain Python, and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, language, linededup, mixing, mtree, neardup, quality, queries, sharding, tokens, toxicity, warc
from cohortry.llm.oracles import ORACLES
from compare import database

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, id int, value int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, a null key and source, and clashing names."""
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", " \n\t", "one", "one", "alpha beta gamma delta epsilon zeta eta theta iota kappa", long, long + " end", "é É ß 日本 x"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", None, "a", "b", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null key", "en", "s0", 1, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where(F.lit(False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    want = database(folder).execute(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)


def test_words_of_bytes():
    texts = ["The Über-cat, 12 ÉÉ", None, "", "end", "start mid", "日本 a1"]
    seen = defaultdict(list)
    for first, data, at in tokens.blocks(pa.array(texts), 8):
        starts, ends, row = tokens.word_bounds(data, at)
        for s, e, r in zip(starts, ends, row, strict=True):
            seen[r + first].append(bytes(data[s:e]).decode().translate(LOWER))
    assert [seen[i] for i in range(len(texts))] == [words(t) for t in texts]


def jaccard(a, b):
    a, b = (set(zip(*[w[i:] for i in range(5)])) if len(w) > 4 else {tuple(w)} for w in (words(a), words(b)))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_signatures_estimate_similarity(weighted):
    random = np.random.default_rng(1)
    common, left, right = (random.integers(0, 2**63, 300).astype(np.uint64) for _ in range(3))
    a, b = np.concatenate([common, left[:100]]), np.concatenate([common, right[:60]])
    wa, wb = (random.integers(1, 6, len(x)).astype(float) for x in (a, b))
    if not weighted:
        wa[:], wb[:] = 1, 1
    rows = np.repeat([0, 1], [len(a), len(b)])
    made = neardup.signatures(rows, np.concatenate([a, b]), np.concatenate([wa, wb]) if weighted else None, 2, 2000)
    low, high = np.minimum(wa[:300], wb[:300]).sum(), np.maximum(wa[:300], wb[:300]).sum()
    want = low / (high + wa[300:].sum() + wb[300:].sum())
    assert abs((made[0] == made[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2000)


def test_repeats_throw_no_darts(monkeypatch):
    thrown, throw = [], neardup._throw

    def counted(*args):
        found = throw(*args)
        thrown.append(len(found[0]))
        return found

    monkeypatch.setattr(neardup, "_throw", counted)
    monkeypatch.setattr(neardup, "add_columns", lambda df, text, fields, compute, keep: compute)
    line = "one line of ten words that fills a whole text"
    texts = [" ".join(["word"] * 3000), " ".join(["word"] * 5), " ".join([line] * 300), " ".join([line] * 2)]
    for weighted in (False, True):
        thrown.clear()
        _, bands, short = neardup.sign(None, "text", neardup.Settings(weighted=weighted), [])(pa.array(texts))
        assert sum(thrown) < 100_000
        if not weighted:  # equal sets of shingles
            assert bands[0] == bands[1] and bands[2] == bands[3] and short[0] == short[1] and short[2] == short[3] and bands[0] != bands[2]


def test_rest_pairs_by_band_values(spark, monkeypatch):
    s = neardup.Settings()
    # all three share band 3 alone; the short forms of 1 and 2 agree everywhere, that of 3 in band 3 only
    short = {i: np.arange(s.size, dtype=np.uint16) + (1000 if i == 3 else 0) for i in (1, 2, 3)}
    short[3][3 * s.rows : 4 * s.rows] -= 1000
    bands = {i: [7 if b == 3 else 100 * i + b for b in range(s.bands)] for i in (1, 2, 3)}
    signed = spark.createDataFrame([(i, bands[i], short[i].tobytes()) for i in (1, 2, 3)], "id long, bands array<long>, short binary")
    rest = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 1)], "bucket long, id long, root long")
    assert [tuple(r) for r in neardup._rest_pairs(rest, signed, s).collect()] == [(1, 2)]
    monkeypatch.setattr(neardup, "add_columns", lambda df, text, fields, compute, keep: compute)
    *_, made = neardup.sign(None, "text", s, [])(pa.array([" ".join(f"w{i}" for i in range(1_000_000))]))
    assert len(set(np.frombuffer(made[0].as_py(), np.uint16))) > 240


def test_near_copies_found_and_others_left(spark, odd, none):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base[:-3], "x", "y", "z"]), " ".join(base[::-1]), "one two", "One, two!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert jaccard(texts[0], texts[2]) >= 0.8
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    odds = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(odd).collect()), key=repr)
    assert (0, 0, 1) in odds and (1, 1, 1) in odds and (4, 3, 2) in odds and (7, 6, 2) in odds and (None, None, 1) in odds and len(odds) == odd.count() and odds.count((5, 5, 3)) == 3
    assert neardup.classes(none).count() == 0
    assert neardup.distinct(odd).columns == odd.columns
    rows = [("k1", " ".join(base), 1), ("k1", " ".join(base[::-1]), 2), ("k0", " ".join([*base[:-1], "x"]), 3), (None, " ".join(base), 4), (None, "own", 5)]
    named = spark.createDataFrame(rows, "doc_id string, text string, _gone int")
    assert sorted(r["_gone"] for r in neardup.distinct(named).collect()) == [2, 3, 5]
    assert sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(named).collect()), key=repr) == sorted([("k1", "k0"), ("k1", "k1"), ("k0", "k0"), (None, "k0"), (None, None)], key=repr)
    assert sorted(r["doc_id"] for r in neardup.distinct(odd).where("doc_id is not null").collect()) == [0, 1, 2, 3, 5, 6, 8]


def test_decontaminate_odd_rows(spark, odd, none):
    items = [(1, "Beta gamma DELTA"), (2, None), (3, ""), (3, "beta gamma delta"), (4, " ".join(f"W{i}" for i in range(500, 540))), (5, "日本 x")]
    items = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.report(odd, items).collect()}
    assert (0, 0, 0, ()) in found and (1, 0, 0, ()) in found and (2, 0, 0, ()) in found
    assert (5, 10, 3, ("1", "3")) in found and (6, 60000, 40, ("4",)) in found and (8, 5, 2, ("5",)) in found
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.report(odd, items.where("false")).where("contaminated").count() == 0
    near = decontaminate.near(odd, spark.createDataFrame([(7, "alpha gamma epsilon"), (8, "alpha epsilon")], "item_id long, text string"), 1)
    assert {(r["item"], r["span"]) for r in near.collect()} == {("7", 5)}


def test_near_with_repeated_words(spark):
    random = np.random.default_rng(5)
    texts = ["a b b x c"] + [" ".join(random.choice(list("abcx"), 12)) for _ in range(40)]
    items = ["a b c", "a a b", "b c", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc"], r["item"], r["begin"], r["span"]) for r in decontaminate.near(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), 1).collect()}
    want = set()
    for d, text in enumerate(texts):
        held = text.split()
        for i, item in enumerate(items):
            first, *others = item.split()
            for begin in [p for p, w in enumerate(held) if w == first]:
                ends = {begin}
                for word in others:
                    ends = {q for p in ends for q in (p + 1, p + 2) if q < len(held) and held[q] == word}
                if ends:
                    want.add((d, str(i), begin, min(ends) - begin + 1))
    assert (0, "0", 0, 5) in found and found == want


def test_mixing_odd_rows(odd, none):
    rows = mixing.shares(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.shares(odd).collect()), key=repr)
    assert mixing.shares(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(odd).count() == sum(r["copies"] for r in rows)


def test_targets_are_met(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.shares(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 20_000 and r["target"] <= 3 * r["source_size"] for r in got)
    assert sum(r["target"] for r in got) == pytest.approx(sum(r["source_size"] for r in got))


def test_sharding_odd_rows(odd, none):
    found = sharding.assign(odd, 100).collect()
    assert len(found) == odd.count()
    size, rows = defaultdict(int), defaultdict(set)
    for r in found:
        size[r["shard"]] += r["n_bytes"]
        rows[r["shard"]].add(r["doc_id"])
    assert all(size[s] <= 100 or len(rows[s]) == 1 for s in size)
    assert all(r["shard_bytes"] == size[r["shard"]] and len(r["shard"]) == r["depth"] for r in found)
    assert all(not b.startswith(a) for a in size for b in size if a != b)
    assert {r["shard"] for r in sharding.assign(odd, 1 << 30).collect()} == {""}
    assert sharding.assign(none, 100).count() == 0


def test_lines_odd_rows(spark, odd, none):
    line = "this line stands on every site"
    rows = [(i, f"{line}\nown line number {i} of this page", f"s{i}") for i in range(6)] + [(9, None, "s1"), (10, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.clean(df).collect()}
    assert found[3] == ("own line number 3 of this page", 2, 1) and found[9] == (None, 0, 0) and found[10] == ("", 1, 0)
    assert linededup.clean(odd).count() == odd.count() and linededup.clean(none).count() == 0


def test_short_lines_on_many_sites_go(spark):
    rows = [(i, f"Menu\n\nOK\n only here {i} \n Menu", f"s{i}") for i in range(6)] + [(6, "OK\nrare", "s1"), (7, "rare", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.clean(df).collect()}
    assert found == {i: (f"\n only here {i} ", 5, 3) for i in range(6)} | {6: ("rare", 2, 1), 7: ("rare", 1, 0)}


def test_archives_hold_anything(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "x" * 3_000_000), (2, "http://b", tricky), (3, None, None), (4, "http://c\r\nX: 1", ""), (5, "http://d", tricky), (5, "http://d", tricky)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_records(df).collect()]
    assert len(rows) == df.count()
    found = {r[0]: r[1:] for r in rows}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert found == {
        1: (3_000_000, digest("x" * 3_000_000), "response", None), 2: (len(tricky), digest(tricky), "response", None), 3: (0, digest(""), "response", None),
        4: (0, digest(""), "revisit", 3), 5: (len(tricky), digest(tricky), "revisit", 2),
    }
    path = str(tmp_path / "w")
    warc.write(df.where("page_id < 3"), path, "page_id", "url", "html")
    whole = {r["response"]["target_uri"]: bytes(r["response"]["block"]).partition(b"\r\n\r\n")[2].decode() for r in warc.captures(warc.read(spark, path)).collect()}
    assert whole == {"http://a": "x" * 3_000_000, "http://b": tricky}
    assert warc.page_records(df.where("false")).count() == 0


def test_one_record_per_page(spark):
    rows = [(1, "http://a", "x"), (1, "http://b", "x"), (None, "http://c", None), (None, "http://d", None), (2, "http://e", "x"), (2, "http://e", "x"), (2, "http://e", "x"), (3, "http://f", ""), (4, "http://f", "")]
    found = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found.collect()), key=repr) == sorted(
        [(1, 1, "response", None)] * 2 + [(None, 0, "response", None)] * 2 + [(2, 1, "revisit", 1)] * 3 + [(3, 0, "response", None), (4, 0, "revisit", 3)], key=repr
    )


def test_changed_payload_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "first page"), (2, "http://b", "first page")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(df, path, "page_id", "url", "html")
    good = warc.checked(warc.captures(warc.read(spark, path))).collect()
    assert {(r["payload_bytes"], r["payload_digest"]) for r in good} == {(10, base64.b32encode(hashlib.sha1(b"first page").digest()).decode())}
    (tmp_path / "bad").mkdir()
    for i, file in enumerate(sorted((tmp_path / "w").glob("*.gz"))):
        (tmp_path / "bad" / f"{i}.warc").write_bytes(gzip.decompress(file.read_bytes()).replace(b"first page", b"first pagE"))
    with pytest.raises(Exception, match="payload differs from its digest"):
        warc.checked(warc.captures(warc.read(spark, str(tmp_path / "bad")))).collect()


def test_archive_of_many_members():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    content = gzip.compress(record) * 100_000
    began = time.process_time()
    assert sum(block == b"body" for _, block in warc.parse(content)) == 100_000
    assert time.process_time() - began < 30


def test_top_k_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0]), (7, [0.5, 0.0]), (7, [0.5, 0.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert [x for x in found if x[0] == 0] == [(0, 1, 1, 2048), (0, 2, 2, 2048), (0, 3, 7, 2048), (0, 4, 20, -4096)]
    assert mtree.top_k(df.where("false"), F.lit(True)).count() == 0


def test_top_k_with_very_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).astype(np.float32).astype(float).tolist()) for i in range(90)]
    rows += [(100, [1e9, 0.0, 0.0, 0.0]), (101, [1e9, 1.0, 0.0, 0.0]), (120, [3e38, -3e38, 0.0, 1.0]), (121, [-3e38] * 4), (140, [1e9, 1e9, 1e9, 1e9])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, settings=mtree.Settings(k=7, block=30, page=4)).collect()}
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = {}
    for q in (i for i in ints if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        want |= {(q, n + 1): (i, max(-(2**63), min(2**63 - 1, -score))) for n, (score, i) in enumerate(best)}
    assert got == want


def test_top_k_over_many_pages(spark):
    random = np.random.default_rng(0)
    data = (random.standard_normal((3000, 8)) + 3 * random.standard_normal((10, 8))[random.integers(0, 10, 3000)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, settings=mtree.Settings(block=200, page=16, chunk=40)).collect()}
    ints = np.floor(data.astype(float) * 64)
    for q in range(0, 3000, 20):
        score = ints @ ints[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(3000), -score))[:20]
        assert [got[q, i + 1] for i in range(20)] == [(int(o), int(score[o])) for o in order]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    return docs.withColumn("held", queries.in_fold(F.col("doc_id"), 4, 2)).cache()


@pytest.mark.parametrize(("module", "label", "caught", "wrong"), [(toxicity, "toxic", 0.5, 0.15), (quality, "quality", 0.95, 0.05)])
def test_held_out_recall(labelled, odd, none, module, label, caught, wrong):
    model = module.fit(labelled.where("not held").withColumn("label", F.col(label)))
    rows = module.score(labelled.where("held"), model, out="s", keep=["doc_id", label]).collect()
    assert all(0 <= r["s"] <= 1 for r in rows)
    ones, zeros = ([r["s"] >= 0.3 for r in rows if r[label] == y] for y in (1, 0))
    assert np.mean(ones) >= caught and np.mean(zeros) <= wrong
    scored = module.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert np.ptp([r["score"] for r in scored if r["doc_id"] == 5]) < 1e-6
    assert module.score(none, model).count() == 0
    empty = module.fit(labelled.where("false").withColumn("label", F.col(label)))
    assert {r["score"] < 0.3 for r in module.score(odd, empty).collect()} == {True}


def test_toxicity_is_a_probability_after_balanced_training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    docs = docs.withColumn("held", queries.in_fold(F.col("doc_id"), 4, 2)).withColumn("label", F.col("toxic"))
    model = toxicity.fit(docs.where("not held"), settings=toxicity.Settings(sample_docs=150))
    rows = toxicity.score(docs.where("held"), model, out="s", keep=["toxic"]).collect()
    toxic, clean = (np.array([r["s"] for r in rows if r["toxic"] == y]) for y in (1, 0))
    assert np.mean(toxic >= 0.3) >= 0.85 and np.mean(clean >= 0.3) <= 0.04
    assert abs(np.mean(np.concatenate([toxic, clean])) - len(toxic) / len(rows)) < 0.03


def test_languages_held_out(labelled, odd, none):
    model = language.fit(labelled.where("not held"))
    rows = language.predict(labelled.where("held"), model, out="found", keep=["lang"]).collect()
    assert np.mean([r["found"] == r["lang"] for r in rows]) >= 0.95
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert found[0] == found[1] == found[2] == ("und", 0.0) and 0 < found[6][1] <= 1
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(labelled.where("false"))).collect()} == {"und"}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    from cohortry.llm.components import components

    draw = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 60 + 40 * seed, (70, 2))]
    links += [(i, i + 1) for i in range(200, 240)]  # a path
    links += [(300, i) for i in range(290, 320)] + links[:5] + [(500, 500)]  # a star around no smallest id, repeats, a row linked to itself
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    real = {x for a, b in links if a != b for x in (a, b)}
    found = [(r["id"], r["root"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(found) == sorted((x, top(x)) for x in real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
