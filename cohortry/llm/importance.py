"""Resampling a collection towards a target by hashed n-gram features.

A feature is a run of one to ``words`` consecutive words; its bucket is its CRC-32 modulo
``buckets``. In each block of texts the distinct features are grouped by their length in bytes into a two-dimensional
matrix of bytes each, whose CRCs are updated together, one column after the other; the buckets are then
scattered back to all places of their features. Bucket counts of collection and target are summed
per task and then over tasks: a fixed number of numbers, however large the collection. They give each bucket a gain, a document
the mean gain of its features, and with a Gumbel term drawn from its key a score. The documents
of the highest scores are drawn by a sort over ranges, so no task ranks all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import local_frame, stored

from . import tokens
from .batches import SLICE_ROWS, add_columns

#: A longer feature is no matrix of many rows any more; zlib computes the same CRC of it by itself.
LONG = 1024


@dataclass(frozen=True)
class Settings:
    words: int = 2  # longest run of words that is a feature
    buckets: int = 10_000
    least_words: int = 20  # shorter documents are not drawn
    share: int = 25  # of a hundred of the others are drawn
    seed: int = 7


def _crc_steps() -> np.ndarray:
    """What each byte value adds to a CRC-32, by its rule."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, np.uint32(0xEDB88320) ^ (steps >> np.uint32(1)), steps >> np.uint32(1))
    return steps


_STEPS = _crc_steps()


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of a byte array; slices of equal length form a matrix and advance column by column."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        size = int(lengths[group[0]])
        if size > LONG:
            out[group] = [zlib.crc32(data[starts[i] : starts[i] + size]) for i in group]
            continue
        matrix = data[starts[group] + np.arange(size)[:, None]]  # a row per column of the text, so each is read in one go
        value = np.full(len(group), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            value = _STEPS[(value ^ column) & np.uint32(255)] ^ (value >> np.uint32(8))
        out[group] = ~value
    return out


def _codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for every slice, the same for equal bytes only: eight bytes at a time, by equal length."""
    out, used = np.zeros(len(starts), np.int64), 0
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        size = int(lengths[group[0]])
        code = np.zeros(len(group), np.int64)
        for first in range(0, size, 8):
            wide = np.zeros((len(group), 8), np.uint8)
            wide[:, : min(8, size - first)] = data[starts[group][:, None] + np.arange(first, min(first + 8, size))]
            eight = pd.factorize(wide.view(np.uint64)[:, 0])[0]
            code = pd.factorize(code << 32 | eight)[0] if first else eight
        out[group] = code + used
        used += int(code.max()) + 1
    return out


def parts(texts: pa.Array, carry: int, most: int = tokens.BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """As ``tokens.blocks``, but a row longer than ``most`` bytes comes in parts cut between words.

    The last number is how many words at the start of a part were in the part before: each further part
    begins with the last ``carry`` of them, so that runs of one word more are whole.
    """
    for first, data, at in tokens.blocks(texts, most):
        if len(data) <= most:
            yield first, data, at, 0
            continue
        begin, end, carried = 0, 0, 0
        while end < len(data):
            end = min(end + most, len(data))
            if end < len(data):
                gaps = np.flatnonzero(~tokens.is_word(data[begin:end]))
                if len(gaps) and begin + gaps[-1] > end - most:
                    end = begin + int(gaps[-1])
                while end < len(data) and tokens.is_word(data[end : end + 1])[0]:  # one word longer than a part
                    ahead = np.flatnonzero(~tokens.is_word(data[end : end + most]))
                    end = end + int(ahead[0]) if len(ahead) else min(end + most, len(data))
            part = data[begin:end]
            yield first, part, np.array([0, len(part)]), carried
            starts, _, _ = tokens.word_bounds(part, np.array([0, len(part)]))
            carried = min(carry, len(starts))
            begin = begin + int(starts[-carried]) if carried else end


def features(data: np.ndarray, at: np.ndarray, carried: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and bucket of every feature, row of every word) of a part; a carried word counts only in longer runs."""
    starts, ends, rows = tokens.word_bounds(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = ends - starts
    # all words in lower case, one blank after each: every run of words is one slice of it
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    clean = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    clean[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = tokens.lower(data[tokens.is_word(data)])
    word = code = _codes(clean, first, lengths)
    found_rows, found = [], []
    for run in range(1, settings.words + 1):
        if run > 1:
            code = code[:-1] << 32 | word[run - 1 :]
        here = np.flatnonzero(rows[: len(code)] == rows[run - 1 :]) if run > 1 else np.arange(len(code))
        if run <= carried:
            here = here[carried - run + 1 :]
        codes, distinct = pd.factorize(code[here])
        where = np.zeros(len(distinct), np.int64)
        where[codes[::-1]] = here[::-1]
        last = where + run - 1
        buckets = crcs(clean, first[where], first[last] + lengths[last] - first[where]) % np.uint32(settings.buckets)
        found.append(buckets.astype(np.int64)[codes])
        found_rows.append(rows[here])
        if run > 1 or settings.words > 1:
            code = pd.factorize(code)[0].astype(np.int64)
    return np.concatenate(found_rows), np.concatenate(found), rows[carried:]


def bucket_counts(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> np.ndarray:
    """How many features of all texts fall in each bucket. Each task sends one row per bucket at most."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            for _, data, at, carried in parts(batch.column(0), s.words - 1):
                total += np.bincount(features(data, at, carried, s)[1], minlength=s.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    summed = df.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(s.buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much more frequent each bucket is in the target, one added to every count; rounded down."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``df`` with n_words, n_features and weight: the mean gain of its features, rounded down, 0 without any."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        n_words, n_features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for first, data, at, carried in parts(texts, settings.words - 1):
            row, bucket, words = features(data, at, carried, settings)
            n_words += np.bincount(words + first, minlength=len(texts))
            n_features += np.bincount(row + first, minlength=len(texts))
            np.add.at(total, row + first, gain[bucket])
        return [pa.array(x) for x in (n_words, n_features, total // np.maximum(n_features, 1))]

    fields = [(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    return add_columns(df, text, fields, compute, keep)


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``df`` with n_words, n_features, weight, score and rank: the place of the drawn rows, null for the others.

    ``keep`` names the columns to return beside these (all by default; they travel through a sort); columns named like the new ones give
    way. A null or empty text has no features and weight 0 and is not drawn. A null key is drawn like an empty one and stands
    last among equal scores; repeated rows are drawn row by row. A target without features is uniform. An empty table gives an empty result.
    """
    s = settings
    made = ("n_words", "n_features", "weight", "score", "rank")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    gain = gains(bucket_counts(df, text, s), bucket_counts(target, text, s))
    sent = df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    plain = [c for c in sent.columns if c != "t"]
    weighed = weights(sent, gain, "t", plain, s)
    half = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(half / 4294967296.0))).cast("long")
    scored = stored(weighed.withColumn("score", score).withColumn("in", F.col("n_words") >= s.least_words))
    drawn = scored.where("in").count() * s.share // 100
    order = [F.desc("in"), F.desc("score"), F.asc_nulls_last("k"), F.asc("n_features"), F.asc("weight")]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a written table, so that places and totals are those of one run
    ordered = stored(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").toArrow()  # a row per range
    n = sizes["n"].to_numpy()
    before = local_frame(df.sparkSession, {"part": sizes["part"].to_pylist(), "before": (np.cumsum(n) - n).tolist()}, {"part": pa.int32(), "before": pa.int64()})
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn("part", part.cast("int")).join(before, "part").withColumn("rank", F.when(place <= drawn, place))
    return ranked.select(*[F.col(f"c{i}") for i in range(len(kept))], *made).toDF(*kept, *made)
