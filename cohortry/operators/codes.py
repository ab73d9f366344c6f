"""Code rows to per-subject flags and counts.

Every category (or code) gets a bit of a 64-bit word. ``bit_or`` keeps one
fixed-size word per subject, so rows are combined before the shuffle, no
distinct pass is needed, and a subject with a third of all rows arrives at the
reducer as one row per map task. Codes beyond one word take further words, each of them a row
of its own per subject that has a code in it; there can be any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import local_frame, stored
from cohortry.sources.codelists import CodeList

WORD = 62


def distinct_codes(df: DataFrame, keys: Sequence[str], code: str = "dsmno") -> DataFrame:
    """Distinct (subject, code) rows. NULL is kept as a code: it is a recorded visit without one."""
    return df.select(*keys, code).distinct()


def _words(count: int) -> list[str]:
    return [f"word{i}" for i in range(max(1, -(-count // WORD)))]


def category_masks(codes: CodeList) -> DataFrame:
    """``code, word0, ...``: the bits of every category a code belongs to.

    A list held on the driver has a checked number of rows and is broadcast. Any
    other list is joined as Catalyst sees fit.
    """
    names = codes.names
    words = _words(len(names))
    if codes.known is not None:
        masks: dict[str, list[int]] = {}
        for _, category, code in codes.known:
            bit = names.index(category)
            masks.setdefault(code, [0] * len(words))[bit // WORD] |= 1 << bit % WORD
        columns = {"code": list(masks)} | {w: [m[i] for m in masks.values()] for i, w in enumerate(words)}
        types = {"code": pa.string()} | {w: pa.int64() for w in words}
        return F.broadcast(local_frame(codes.codes.sparkSession, columns, types))
    bits = [
        F.bit_or(
            F.coalesce(
                *(F.when(F.col("category") == name, F.lit(1 << b)) for b, name in enumerate(names[i : i + WORD])),
                F.lit(0),
            ).cast("long")
        ).alias(word)
        for i, word in zip(range(0, max(1, len(names)), WORD), words, strict=True)
    ]
    return codes.codes.groupBy("code").agg(*bits)


def _bit(position: int) -> Column:
    word = F.col(f"word{position // WORD}")
    return F.getbit(word, F.lit(position % WORD)).cast("int")


def category_flags(
    df: DataFrame, codes: CodeList, keys: Sequence[str], code: str = "dsmno", listed_only: bool = False
) -> DataFrame:
    """One row per subject, one 0/1 column per category.

    With ``listed_only`` subjects without any listed code have no row, and their
    codes are dropped before the shuffle.
    """
    masks = category_masks(codes)
    words = [name for name in masks.columns if name != "code"]
    joined = df.select(*keys, F.col(code).alias("code")).join(masks, "code", "inner" if listed_only else "left")
    packed = joined.groupBy(*keys).agg(*(F.bit_or(F.coalesce(w, F.lit(0).cast("long"))).alias(w) for w in words))
    return packed.select(*keys, *(_bit(i).alias(name) for i, name in enumerate(codes.names)))


def _code_bits(codes: CodeList, size: int) -> tuple[DataFrame, DataFrame, int | None]:
    """``code, word, bit`` of every listed code; ``word`` and a mask per category; the number of words if it is known.

    A list held on the driver gives two small local tables. Any other list is numbered by Spark, in the order of its codes.
    """
    names, spark = codes.names, codes.codes.sparkSession
    if codes.known is not None:
        listed = sorted({code for _, _, code in codes.known})
        place = {code: divmod(i, size) for i, code in enumerate(listed)}
        masks = {word: [0] * len(names) for word in range(-(-len(listed) // size))}
        for _, category, code in codes.known:
            word, bit = place[code]
            masks[word][names.index(category)] |= 1 << bit
        columns = {"code": listed, "word": [place[c][0] for c in listed], "bit": [1 << place[c][1] for c in listed]}
        index = F.broadcast(local_frame(spark, columns, {"code": pa.string(), "word": pa.int32(), "bit": pa.int64()}))
        columns = {"word": list(masks)} | {f"m{i}": [row[i] for row in masks.values()] for i in range(len(names))}
        kinds = {name: pa.int32() if name == "word" else pa.int64() for name in columns}
        return index, F.broadcast(local_frame(spark, columns, kinds)), len(masks)
    # one row per listed code, and a code list is no collection of records
    number = F.row_number().over(Window.orderBy("code")) - 1
    numbered = codes.codes.select("code").where("code is not null").distinct().withColumn("number", number)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("number", F.lit(size)).cast("int"))
    index = stored(numbered.select("code", F.floor(F.col("number") / size).cast("int").alias("word"), bit.alias("bit")))
    none = F.lit(0).cast("long")
    sums = [F.bit_or(F.when(F.col("category") == name, F.col("bit")).otherwise(none)).alias(f"m{i}") for i, name in enumerate(names)]
    return index, stored(codes.codes.join(index, "code").groupBy("word").agg(*sums)), None


def category_counts(df: DataFrame, codes: CodeList, keys: Sequence[str], code: str = "dsmno", word_bits: int = WORD) -> DataFrame:
    """One row per subject, one column per category: how many distinct codes of it were recorded.

    A subject's words are combined before the shuffle, and what is recorded twice is one bit. Where there is only one word, its rows
    are the subjects' already.
    """
    index, masks, words = _code_bits(codes, word_bits)
    none = F.lit(0).cast("long")
    met = df.select(*keys, F.col(code).alias("code")).join(index, "code", "left")
    own = [F.coalesce("word", F.lit(0)).alias("word")] if words is None or words > 1 else []
    seen = met.select(*keys, *own, F.coalesce("bit", none).alias("bit")).groupBy(*keys, *(["word"] if own else [])).agg(F.bit_or("bit").alias("bits"))
    if own:
        # a subject without listed codes has a word without bits
        counted = seen.join(masks, "word", "left")
        sums = [F.sum(F.bit_count(F.col("bits").bitwiseAND(F.coalesce(f"m{i}", none)))).alias(name) for i, name in enumerate(codes.names)]
        return counted.groupBy(*keys).agg(*sums)
    only = masks.first() if words else None
    counts = [F.bit_count(F.col("bits").bitwiseAND(F.lit(only[f"m{i}"] if only else 0).cast("long"))).cast("long").alias(name) for i, name in enumerate(codes.names)]
    return seen.select(*keys, *counts)


def binary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts to 0/1 flags."""
    return df.withColumns({name: (F.col(name) > 0).cast("int") for name in names})


def with_summary(df: DataFrame, substances: Sequence[str], diagnoses: Sequence[str]) -> DataFrame:
    """Row-wise numbers of flags, and the any / two-or-more substance flags."""

    def total(names: Sequence[str]) -> Column:
        return sum((F.col(name) for name in names), F.lit(0))

    counted = df.withColumns({"sud_count": total(substances), "dx_count": total(diagnoses)})
    return counted.withColumns(
        {f: (F.col("sud_count") >= k).cast("int") for f, k in (("any_sud", 1), ("ge2_sud", 2))}
    )
