"""Near-duplicate classes by DartMinHash signatures and banded joins.

Each text is a weighted set of word shingles. Hashed darts fall on the plane of
weight and rank of every shingle, the same ones in every text; a text keeps those
below the shingle's weight and below a rank bound that depends on the text's
total weight only, so a text of any length looks at about k ln k darts. Each dart
belongs to one of k coordinates; the earliest dart of a coordinate is its signature
value. Two texts agree in a coordinate with the probability of their (weighted) Jaccard similarity.

Steps, all in Spark:

1. One pass over the texts gives each a digest of its words and its signature.
   Equal digests are one class; only the smallest id of a class goes on.
2. Bands of the signature are joined. In each bucket every member is compared with
   one leader, a member that shares the most buckets; the comparison is of whole texts.
3. Members still apart from some of their bucket are compared with a second leader, and what
   then remains with all members of other classes in the bucket, in blocks of bounded size: signatures there,
   whole texts for those that could be similar enough. No pair that shares a band
   is left out, except by four standard deviations of the signature's estimate.
4. Connected components of the links found, plus the classes of equal words.

A link of similarity ``s`` shares no band with probability ``(1 - s**rows) ** bands``:
5e-5 at 0.8, 3e-10 at 0.9.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import stored

from . import tokens
from .batches import add_columns
from .components import components


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    extra: int = 125  # coordinates beyond the bands, for a closer estimate
    weighted: bool = False  # True: a shingle weighs as often as it occurs
    block: int = 1000  # members of a bucket that one comparison block holds

    @property
    def size(self) -> int:
        return self.bands * self.rows + self.extra


#: Rank regions start with one of this area; they double up to area 1.
_FIRST_AREA = 2.0**-4
#: Chance of at most n darts in a region of area 1; beyond these terms it is below 1e-12.
_POISSON_TERMS = 16


def _uniform(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _counts(uniform: np.ndarray, area: float) -> np.ndarray:
    """Poisson numbers of mean ``area``."""
    chance = math.exp(-area)
    total, out = chance, np.zeros(len(uniform), np.int64)
    for n in range(1, _POISSON_TERMS):
        more = uniform >= total
        if not more.any():
            break
        out += more
        chance *= area / n
        total += chance
    return out


def _throw(rows: np.ndarray, items: np.ndarray, weights: np.ndarray | None, limit: np.ndarray, size: int):
    """All darts of the items below weight and rank bound: (row, coordinate, rank, dart).

    ``limit`` is the rank bound of each item's row. Weight regions are [0,1), [1,2),
    [2,4), ...; rank regions of a weight region of width w have area at most 1.
    """
    found = []

    def region(who: np.ndarray, number: np.ndarray | int, begin: np.ndarray | float, area: float) -> None:
        """Darts of one region of each item: of the weight region at hand, ``begin`` ranks up."""
        salt = tokens.mix(items[who] + np.uint64((level + 1) * 0xA24BAED4963EE407 % 2**64) + np.asarray(number).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        count = _counts(_uniform(salt), area)
        some = count > 0
        base, who, count = salt[some], who[some], count[some]
        if not len(base):
            return
        start = begin[some] if isinstance(begin, np.ndarray) else begin
        if count.max() > 1:
            each = np.repeat(np.arange(len(base)), count)
            order = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            base, who = base[each] + order.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), who[each]
            start = start[each] if isinstance(start, np.ndarray) else start
        dart = tokens.mix(base + np.uint64(0x2545F4914F6CDD1D))
        rank = start + _uniform(dart) * (area / width)
        keep = rank < limit[who]
        if weights is not None:
            keep &= low + _uniform(tokens.salted(dart, 7)) * width < weights[who]
        dart, rank, who = dart[keep], rank[keep], who[keep]
        found.append((rows[who], ((tokens.salted(dart, 11) >> np.uint64(32)) % np.uint64(size)).astype(np.int64), rank, dart))

    level, low, width = 0, 0.0, 1.0
    active = np.arange(len(items))
    while len(active):
        number, begin, area, here = 0, 0.0, _FIRST_AREA, active
        while len(here) and begin * width < 1:  # two equally wide regions, then each twice as wide, up to area 1
            region(here, number, begin, area)
            begin += area / width
            area = area * 2 if number else area
            number += 1
            here = here[limit[here] > begin]
        if len(here):  # then all regions of area 1 at once
            count = np.ceil((limit[here] - begin) * width).astype(np.int64)
            each = np.repeat(here, count)
            order = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            region(each, number + order, begin + order / width, 1.0)
        low, width, level = low + width, (width * 2 if level else 1.0), level + 1
        active = active[weights[active] > low] if weights is not None else active[:0]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, np.uint64)]


def signatures(rows: np.ndarray, items: np.ndarray, weights: np.ndarray | None, n_rows: int, size: int) -> np.ndarray:
    """n_rows x size signature values; a row without items has zeros. The items of a row are distinct.

    Darts are thrown below a rank bound that suits the row's weight; rows with an
    empty coordinate get a bound twice as high, which changes no coordinate already filled.
    """
    out = np.zeros((n_rows, size), np.uint64)
    total = np.bincount(rows, weights, n_rows).astype(np.float64)
    factor = size * math.log(size) + 2 * size
    open_rows = np.flatnonzero(total > 0)
    while len(open_rows):
        chosen = np.isin(rows, open_rows) if len(open_rows) < n_rows else slice(None)
        r, w = rows[chosen], None if weights is None else weights[chosen]
        at, place, rank, dart = _throw(r, items[chosen], w, factor / total[r], size)
        order = np.argsort(rank)[::-1]  # the earliest is written last
        out[at[order], place[order]] = dart[order]
        seen = np.zeros((n_rows, size), bool)
        seen[at, place] = True
        open_rows = open_rows[~seen[open_rows].all(axis=1)]
        factor *= 2
    return out


def _row_shingles(texts: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of rows, word hashes, their rows, shingles, their rows) of each block."""
    for first, data, at in tokens.blocks(texts, 1 << 19):
        starts, ends, row = tokens.word_bounds(data, at)
        words = tokens.word_hashes(data, starts, ends)
        grams, gram_rows = tokens.shingles(words, row, s.shingle)
        yield first, len(at) - 1, words, row, grams, gram_rows


def _weigh(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with their number."""
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])]) if len(grams) else np.zeros(0, np.int64)
    return grams[new], rows[new], np.diff(np.r_[new, len(grams)]).astype(np.float64)


def sign(df: DataFrame, text: str, s: Settings, keep: list[str]) -> DataFrame:
    """Digest of the words (null without words), band values and a short form of the signature of each text."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        digest: list[bytes | None] = [None] * len(texts)
        bands: list[np.ndarray | None] = [None] * len(texts)
        short: list[bytes | None] = [None] * len(texts)
        for first, n, words, row, grams, gram_rows in _row_shingles(texts, s):
            grams, gram_rows, weights = _weigh(grams, gram_rows)
            values = signatures(gram_rows, grams, weights if s.weighted else None, n, s.size)
            joined = values[:, : s.bands * s.rows].reshape(n, s.bands, s.rows)
            band = np.zeros((n, s.bands), np.uint64)
            for i in range(s.rows):
                band = band * np.uint64(0x100000001B3) + joined[:, :, i]
            band = tokens.mix(band + np.arange(s.bands, dtype=np.uint64)).view(np.int64)
            # salted: a dart's own high bits tell its rank, and the earliest ones of a long text share them
            brief = (tokens.salted(values, 13) >> np.uint64(48)).astype(np.uint16)
            cut = np.searchsorted(row, np.arange(n + 1))
            for i in range(n):
                if cut[i] < cut[i + 1]:
                    digest[first + i] = hashlib.blake2b(words[cut[i] : cut[i + 1]].tobytes(), digest_size=16).digest()
                    bands[first + i], short[first + i] = band[i], brief[i].tobytes()
        return [pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())]

    fields = [("digest", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("short", T.BinaryType())]
    return add_columns(df, text, fields, compute, keep)


def similarity(left: pa.Array, right: pa.Array, s: Settings) -> np.ndarray:
    """The Jaccard similarity of whole texts, row by row."""
    sides: list[list] = []
    for texts in (left, right):
        made: list = [None] * len(texts)
        for first, n, _, _, grams, rows in _row_shingles(texts, s):
            grams, rows, weights = _weigh(grams, rows)
            cut = np.searchsorted(rows, np.arange(n + 1))
            for i in range(n):
                made[first + i] = (grams[cut[i] : cut[i + 1]], weights[cut[i] : cut[i + 1]])
        sides.append(made)
    out = np.zeros(len(left))
    for i, ((a, wa), (b, wb)) in enumerate(zip(*sides, strict=True)):
        if s.weighted:
            _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            common, total = np.minimum(wa[ia], wb[ib]).sum(), wa.sum() + wb.sum()
        else:
            both = np.sort(np.concatenate([a, b]))
            common, total = np.count_nonzero(both[1:] == both[:-1]), len(a) + len(b)
        out[i] = common / (total - common) if total else 0.0
    return out


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose whole texts are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                good = similarity(part.column(2), part.column(3), s) >= s.threshold - 1e-12
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    return met.mapInArrow(check, "a long, b long")


def _lowest_estimate(s: Settings) -> float:
    """Four standard deviations below the threshold, of an estimate from ``size`` coordinates."""
    return s.threshold - 4 * math.sqrt(s.threshold * (1 - s.threshold) / s.size)


def _star_pairs(members: DataFrame, s: Settings) -> DataFrame:
    """Each member with its bucket's leader: the one of another class that shares most buckets."""
    # packed into one number so that the leader is found by a hash aggregate: many buckets first, then the smallest id
    lead = F.max(F.struct("shared", -F.col("id")))
    leaders = stored(members.groupBy("bucket").agg(lead.alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", (-F.col("lead.col2")).alias("leader")))
    pairs = members.join(leaders, "bucket").where(F.col("id") != F.col("leader"))
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _rest_pairs(rest: DataFrame, signed: DataFrame, s: Settings) -> DataFrame:
    """Pairs of one bucket and different classes whose signatures could be those of similar texts.

    A bucket is cut into blocks; each two blocks meet in one group, compared by
    array operations. A group holds at most two blocks' band values and short signatures. A pair that
    shares several band values comes from the first of them only.
    """
    sizes = rest.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    dealt = rest.join(sizes, "bucket").join(signed.select("id", "bands", "short"), "id").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("own", own).select("bucket", "id", "root", "bands", "short", "own", other.alias("other"))
    dealt = dealt.select("bucket", "id", "root", "bands", "short", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    least = _lowest_estimate(s)

    def compare(table: pa.Table) -> pa.Table:
        ids, roots, own = (table[c].to_numpy() for c in ("id", "root", "own"))
        short = np.frombuffer(b"".join(table["short"].to_pylist()), np.uint16).reshape(len(ids), s.size)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        bands = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), s.bands)
        band = int((bands == table["bucket"][0].as_py()).any(axis=0).argmax())  # the one this bucket is of
        found_a, found_b = [], []
        for at in left:
            against = right[(roots[right] != roots[at]) & ((ids[right] > ids[at]) | (i != j))]
            same = short[against] == short[at]
            sooner = (bands[against, :band] == bands[at, :band]).any(axis=1)
            near = against[(same.sum(axis=1) >= least * s.size) & ~sooner]
            found_a.append(np.minimum(ids[near], ids[at]))
            found_b.append(np.maximum(ids[near], ids[at]))
        return pa.table({"a": np.concatenate(found_a) if found_a else np.zeros(0, np.int64), "b": np.concatenate(found_b) if found_b else np.zeros(0, np.int64)})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets in which more than one class is left, with their class, as a written table."""
    found = stored(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    mixed = stored(found.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"))
    return stored(found.join(mixed, "bucket"))


def _linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows hanging on the root of their class and further links, together."""
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links)


def _numbered(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows under numbers of their own (id), as a written table: read again, a row has the same number."""
    return stored(df.select(F.monotonically_increasing_id().alias("id"), *columns))


def _roots(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, root) of the rows of a written table (id, text) that are linked to another row, as a written table; root is the smallest id."""
    signed = stored(sign(docs, "text", s, ["id"]))
    words = signed.where(F.col("digest").isNotNull())
    firsts = stored(words.groupBy("digest").agg(F.min("id").alias("first")))
    equal = words.select("id", "digest").join(firsts, "digest").where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    # one row per class of equal words
    single = stored(words.join(firsts, ["digest"]).where(F.col("id") == F.col("first")).select("id", "bands", "short"))
    bands = single.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    full = stored(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    crowded = stored(bands.join(full, "bucket"))
    share = stored(crowded.groupBy("id").agg(F.sum("n").alias("shared")))
    members = stored(crowded.join(share, "id").select("bucket", "id", "shared"))
    # The texts of those that share a bucket with another: read once, and all that later joins shuffle.
    texts = stored(docs.select("id", "text").join(share.select("id"), "id", "left_semi"))
    roots = components(_verified(_star_pairs(members, s), texts, s))
    rest = _apart(members, roots)
    roots = components(_linked(roots, _second_star(rest, texts, s)))
    rest = _apart(rest.select("bucket", "id", "shared"), roots)
    links = _verified(_rest_pairs(rest, single.select("id", "bands", "short"), s), texts, s)
    # Both kinds of link together: rows of equal words hang on the row that was compared.
    return components(_linked(roots, links).unionByName(equal))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, class_id, class_size) of every row: texts linked, directly or in steps, by a similarity of at least the threshold.

    ``class_id`` is the smallest key of the class, of whatever type keys are; null keys come last. Texts of equal words (case of A
    to Z and punctuation aside) are one class. A text without words, null or
    empty, is a class of its own; so is any text without a near copy, and a class of null keys alone has the class id null. Rows of one key are
    rows like any other: if their texts differ, they need not be in one class. A text of fewer words than a shingle is
    one shingle. Other columns play no part. An empty table gives an empty result.
    """
    docs = _numbered(df, [F.col(key).alias("key"), F.col(text).alias("text")])
    roots = _roots(docs, settings)
    out = stored(docs.select("id", "key").join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("root")))
    sizes = stored(out.groupBy("root").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")))
    return out.join(sizes, "root").select(F.col("key").alias(key), "class_id", "class_size")


def _second_star(rest: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links of members outside their bucket's largest-leader class with a leader of their own."""
    top = stored(rest.groupBy("bucket").agg(F.max(F.struct("shared", -F.col("id"), "root")).alias("lead")).select("bucket", F.col("lead.root").alias("main")))
    outside = rest.join(top, "bucket").where(F.col("root") != F.col("main")).select("bucket", "id", "shared")
    return _verified(_star_pairs(stored(outside), s), texts, s)


def distinct(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``df`` with one row of each class: a row of the smallest key, null keys last, and of those the row read first.

    All columns stay, whatever their names. Rows of one key with different texts are told apart; rows with a null or empty text all stay.
    """
    docs = _numbered(df, [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    at = {c: F.col(f"c{i}") for i, c in enumerate(df.columns)}
    roots = _roots(docs.select("id", at[text].alias("text")), settings)
    held = docs.select("id", at[key].alias("key")).join(roots, "id").select("root", "key", "id")
    best = held.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "id")).alias("best")).select("root", F.col("best.id").alias("best"))
    gone = stored(held.join(best, "root").where("id != best").select("id"))
    return docs.join(gone, "id", "left_anti").drop("id").toDF(*df.columns)
