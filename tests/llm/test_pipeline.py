"""The corpus pipeline's stages, each held against what it has to do."""

from __future__ import annotations

from collections import defaultdict

from test_text_operators import jaccard, words

import corpus_pipeline
from cohortry.llm import queries


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    before = queries.table(spark, folder, "documents")
    names = before.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, before, folder)
    assert clean.columns == names and 0 < clean.count() <= before.count()
    single = stages["near duplicates"](spark, clean, folder)
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == names and kept <= set(rows)
    texts = [(i, rows[i]) for i in sorted(kept) if rows[i]]
    assert all(jaccard(a, b) < 0.8 for n, (_, a) in enumerate(texts) for _, b in texts[n + 1 :] if words(a) and words(b))
    assert all(any(jaccard(rows[i], rows[j]) >= 0.8 for j in rows if j != i) for i in set(rows) - kept)
    pure = stages["decontamination"](spark, single, folder)
    items = [words(r["text"]) for r in queries.table(spark, folder, "benchmark").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert pure.columns == names and {r["doc_id"] for r in pure.collect()} == {i for i in kept if not hit(rows[i])}
    mix = stages["mixing"](spark, pure, folder)
    assert mix.columns == names
    size = defaultdict(int)
    for r in mix.collect():
        size[r["doc_id"]] += 1
    assert max(size.values()) <= 3 and set(size) <= kept
    last = stages["sharding"](spark, mix, folder)
    assert last.count() == mix.count() and set(names) < set(last.columns)


def test_stages_on_odd_rows(spark):
    """Null, empty, very long and repeated texts, one key with two texts, a null key, and names that operators use."""
    folder = "/root/testdata/sf0.001"
    prose = " ".join(f"word{i}" for i in range(80))
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    texts = [(1, None), (2, ""), (3, prose), (3, prose), (3, prose[::-1]), (4, prose + " more"), (5, long), (None, prose), (6, "short")]
    rows = [(i, t, "en", None if n == 2 else "s", 1, float(n), "x", n, "b", 5) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _gone string, contaminated int, shard string, c0 int")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            found = stage(spark, given, folder)
            assert name == "sharding" or found.columns == docs.columns
            seen[name] = found.select("doc_id", "text", *["contaminated"] * (name != "sharding")).collect()
            assert given is docs or not seen[name]
            if given is docs:
                kept = seen[name]
                assert name in ("toxicity", "near duplicates", "mixing") or len(kept) == len(rows), name
                if name == "near duplicates":
                    assert sorted(r["contaminated"] for r in kept) in ([0, 1, n, 4, 6, 8] for n in (2, 3))
