"""Benchmark passages in documents by a distributed positional inverted index.

The index is a table of postings (term, document, place), of the terms that occur
in test items, written once. A window is a run of consecutive words of an item. For
each window the rarest term by postings is looked up first; its places, less the
term's offset in the window, are where the window could begin. They are intersected
with the equally adjusted places of the window's second-rarest term, and what is left
with those of all its terms. Where a run of consecutive places is as long as a
window, the window occurs there.

Everything is DataFrame operations; terms meet postings in equi-joins, so Catalyst
broadcasts the test side only while its written size is below the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import stored

#: Everything but ASCII letters and digits and characters beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words of a text in their case; an empty string may stand first and last."""
    return F.split(text, SEPARATORS)


def count_words(text: Column) -> Column:
    """Number of words; null has none."""
    words = split_words(text)
    return F.coalesce(F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int"), F.lit(0)).cast("long")


def lower_word(word: Column) -> Column:
    """A to Z in lower case and nothing else changed; only words with characters beyond ASCII take the slow way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words_at(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, place, term) of every word; places are consecutive, the first may be 0 or 1."""
    spread = df.select(*keys, F.posexplode(split_words(F.col(text))).alias("place", "word")).where("word != ''")
    return spread.select(*keys, "place", lower_word(F.col("word")).alias("term"))


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, copy, place, term, words) of the items; ``copy`` tells apart texts of one id, places count from 0."""
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    rows = rows.withColumn("copy", F.xxhash64("text"))
    spread = words_at(rows, "text", "item", "copy")
    size = Window.partitionBy("item", "copy")
    return spread.withColumn("words", F.count("*").over(size)).withColumn("place", F.col("place") - F.min("place").over(size))


def index(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """The written postings (term number, document, place) of the given terms (term, t) in all documents."""
    return stored(words_at(docs, text, "doc", "sum").join(terms, "term").select("t", "doc", "sum", "place"))


def matches(postings: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(doc, sum, item, place): words of documents inside an occurrence of a window of an item.

    ``items`` are rows (item, copy, place, t, words).
    """
    freq = stored(postings.groupBy("t").agg(F.count("*").alias("n")))
    # Windows as (item, copy, begin, length) with each term's offset; terms never posted rule a window out.
    size = F.least(F.lit(window), "words")
    begins = F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - size + 1), F.least("place", F.col("words") - size)))
    windows = items.join(freq, "t", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("item", "copy", "words", "place", "t", "n", begins.alias("begin"))
    rarity = Window.partitionBy("item", "copy", "begin").orderBy("n", "t", "place")
    ranked = windows.withColumn("r", F.row_number().over(rarity)).where("r <= 2")
    plan = ranked.groupBy("item", "copy", "begin", "words").agg(
        F.min("n").alias("least"),
        *[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("t", "place")],
    )
    # Alignments repeat over a window's neighbours: of windows with the same two terms at the same places one look-up is enough.
    plan = stored(plan.where("least > 0"))
    looked = stored(plan.select("item", "copy", "t1", "place1", "t2", "place2").distinct())
    first = postings.join(looked, F.col("t") == F.col("t1")).select("doc", "sum", "item", "copy", "t1", "place1", "t2", "place2", (F.col("place") - F.col("place1")).alias("shift"))
    seconds = looked.where("t2 is not null").select(F.col("t2").alias("t")).distinct()
    second = postings.join(seconds, "t", "left_semi").select("doc", "sum", F.col("t").alias("t2"), F.col("place").alias("at"))
    alone = first.where("t2 is null")
    pairs = first.where("t2 is not null").withColumn("at", F.col("shift") + F.col("place2")).join(second, ["doc", "sum", "t2", "at"])
    cut = pairs.select("doc", "sum", "item", "copy", "shift", "place1", "place2").unionByName(alone.select("doc", "sum", "item", "copy", "shift", "place1", F.col("place1").alias("place2")))
    lined = stored(cut.distinct())
    # All places that the windows around the two terms need, once per alignment.
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.greatest("place1", "place2") - window + 1), F.least("place1", "place2") + window - 1))
    wanted = lined.select("doc", "sum", "item", "copy", "shift", around.alias("place")).distinct()
    wanted = wanted.join(items.select("item", "copy", "place", "t", "words"), ["item", "copy", "place"])
    wanted = wanted.select("doc", "sum", "item", "copy", "shift", "words", F.col("place").alias("own"), "t", (F.col("shift") + F.col("place")).alias("place"))
    found = wanted.join(postings.join(stored(lined.select("doc", "sum").distinct()), ["doc", "sum"], "left_semi"), ["doc", "sum", "t", "place"])
    # Runs of consecutive places on one alignment.
    run = Window.partitionBy("doc", "sum", "item", "copy", "shift")
    runs = found.distinct().withColumn("run", F.col("own") - F.row_number().over(run.orderBy("own")))
    whole = Window.partitionBy("doc", "sum", "item", "copy", "shift", "run")
    return runs.withColumn("length", F.count("*").over(whole)).where(F.col("length") >= size).select("doc", "sum", "item", "place")


def phrase_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(doc, sum, item, place) of every word of ``docs`` inside an occurrence of an item window; sum is a hash of the text."""
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("sum")).where("text is not null")
    lines = stored(item_terms(items, item, item_text))
    terms = stored(lines.select("term").distinct().withColumn("t", F.xxhash64("term")))
    numbered = stored(lines.join(terms, "term").select("item", "copy", "place", "t", "words"))
    # a null key is a key like any other here
    postings = index(rows.withColumn("doc", F.coalesce(F.col("doc").cast("long"), F.lit(-(2**63)))), terms, "text")
    return matches(postings, numbered, window)


def near(docs: DataFrame, items: DataFrame, slack: int, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, sum, item, begin, span): places where all words of an item occur in order, with at most ``slack`` words between neighbours.

    The places of each next word are joined with those of the word before, so only chains that still hold go on.
    Every place a chain from ``begin`` can have reached goes on, once; the span is that of the shortest whole chain.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("sum")).where("text is not null")
    lines = stored(item_terms(items, item, item_text))
    terms = stored(lines.select("term").distinct().withColumn("t", F.xxhash64("term")))
    steps = stored(lines.join(terms, "term").select("item", "copy", F.col("place").alias("step"), "t", "words"))
    postings = index(rows, terms, "text")
    chains = postings.join(steps.where("step = 0"), "t").select("doc", "sum", "item", "copy", "words", F.col("place").alias("begin"), F.col("place").alias("end"))
    done, step = None, 0
    while True:
        chains = stored(chains)
        ended = chains.where(F.col("words") == step + 1)
        done = ended if done is None else done.unionByName(ended)
        open_chains = chains.where(F.col("words") > step + 1)
        if open_chains.isEmpty():
            break
        step += 1
        wanted = open_chains.join(steps.where(F.col("step") == step).select("item", "copy", "t"), ["item", "copy"])
        wanted = wanted.withColumn("place", F.explode(F.sequence(F.col("end") + 1, F.col("end") + 1 + slack)))
        met = wanted.join(postings, ["doc", "sum", "t", "place"])
        chains = met.select("doc", "sum", "item", "copy", "words", "begin", F.col("place").alias("end")).distinct()
    first = done.groupBy("doc", "sum", "item", "copy", "begin").agg(F.min("end").alias("end"))
    return first.select("doc", "sum", "item", "begin", (F.col("end") - F.col("begin") + 1).alias("span")).distinct()


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with its number of words and hit words, and the items whose windows occur in it.

    New columns: n_words, n_hit, n_items, items (ids as text, sorted) and contaminated;
    a column of ``docs`` of such a name gives way. ``keep`` names those to keep beside them (all by default). A null or
    empty text has no words and no hits; an item without words has no window; repeated
    rows each get the same result; equal item ids count once. Empty tables give an empty or a clean result.
    """
    hits = phrase_hits(docs, items, key, text, item, item_text, window)
    hits = stored(hits.select("doc", "sum", "item", "place").distinct())
    by_doc = hits.groupBy("doc", "sum").agg(F.countDistinct("place").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = stored(by_doc.toDF("_doc", "_sum", "_hit", "_items"))
    new = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    side = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_doc"),
        F.xxhash64(F.col(text)).alias("_sum"), count_words(F.col(text)).alias("_words"),
    )
    made = side.join(by_doc, ["_doc", "_sum"], "left")
    n_hit, found = F.coalesce("_hit", F.lit(0)).cast("long"), F.coalesce("_items", F.array().cast("array<string>"))
    return made.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), (n_hit > 0).alias("contaminated"),
    )
