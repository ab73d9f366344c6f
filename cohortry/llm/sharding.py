"""Shards of bounded size by extendible hashing.

A row's shard is the shortest prefix of its key's hash bits under which all rows
together fit the byte limit. The directory has one entry per prefix of a fixed
number of bits and says how many of them count; only prefixes whose rows do not fit
are looked at more closely, with more bits, in another round. Sizes are counted per
prefix, so no row is moved to find its shard and no task holds a bucket's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.session import stored

_HALF = 48
_BITS = 2 * _HALF
#: Bits that a round looks at beyond those that equal parts would need.
_SPARE_BITS = 2
_MORE_BITS = 12


def _bits_of(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _HALF // 4), 16, 10).cast("long")


def key_bits(key: Column) -> Column:
    """The first 48 hash bits of a key; null counts as an empty one."""
    return _bits_of(F.md5(F.coalesce(key.cast("string"), F.lit(""))))


def _prefix(length: Column) -> list[Column]:
    """The first ``length`` of a row's 96 bits, as two numbers."""
    high = F.call_function("shiftright", F.col("_h1"), F.greatest(F.lit(0), F.lit(_HALF) - length))
    low = F.call_function("shiftright", F.col("_h2"), F.lit(_BITS) - F.greatest(length, F.lit(_HALF)))
    return [F.when(length > _HALF, F.col("_h1")).otherwise(high).alias("_p1"), F.when(length > _HALF, low).otherwise(F.lit(0).cast("long")).alias("_p2")]


def _shorter(length: Column, bits: int) -> list[Column]:
    """The first ``length`` bits of a prefix (_p1, _p2) of ``bits`` bits."""
    if bits <= _HALF:
        return [F.call_function("shiftright", F.col("_p1"), F.lit(bits) - length).alias("_p1"), F.lit(0).cast("long").alias("_p2")]
    high = F.call_function("shiftright", F.col("_p1"), F.greatest(F.lit(0), F.lit(_HALF) - length))
    low = F.call_function("shiftright", F.col("_p2"), F.lit(bits) - F.greatest(length, F.lit(_HALF)))
    return [high.alias("_p1"), F.when(length > _HALF, low).otherwise(F.lit(0).cast("long")).alias("_p2")]


def _directory(fine: DataFrame, bits: int, from_bits: int, limit: int) -> DataFrame:
    """(prefix of ``bits`` bits, length, bytes of the shard, settled) from the sizes of those prefixes."""
    lengths = F.explode(F.sequence(F.lit(from_bits), F.lit(bits))).alias("_length")
    opened = fine.select("*", lengths)
    wide = opened.select("_length", *[c.alias(f"_n{i}") for i, c in enumerate(_shorter(F.col("_length"), bits), 1)], "_p1", "_p2", "_bytes", "_low1", "_high1", "_low2", "_high2")
    nodes = wide.groupBy("_length", "_n1", "_n2").agg(
        F.sum("_bytes").alias("_size"), F.min("_low1").alias("_low1"), F.max("_high1").alias("_high1"), F.min("_low2").alias("_low2"), F.max("_high2").alias("_high2")
    )
    # rows that share all bits cannot be parted; a row by itself is such a case
    alike = (F.col("_low1") == F.col("_high1")) & (F.col("_low2") == F.col("_high2"))
    fits = nodes.where((F.col("_size") <= limit) | alike).select("_length", "_n1", "_n2", "_size")
    met = wide.select("_length", "_n1", "_n2", "_p1", "_p2").join(stored(fits), ["_length", "_n1", "_n2"])
    best = met.groupBy("_p1", "_p2").agg(F.min("_length").alias("_depth"), F.min_by("_size", "_length").alias("_shard_bytes"))
    return best


def assign(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with shard (the bits of its prefix), depth, n_bytes (of the text) and shard_bytes.

    Every shard holds at most ``limit`` bytes of text, unless a single row alone, or rows equal in key
    and text, exceed it: they are a shard by themselves. Rows of one key stay
    together while they fit, else they are parted by their text. A null key is a key; null
    and empty texts have 0 bytes. Of an empty table nothing is left to assign. If everything fits, the
    one shard is the empty prefix. Columns named like the new ones give way; ``keep`` names the columns to keep (all by default).
    """
    new = ["shard", "depth", "n_bytes", "shard_bytes"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    second = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(F.col(text)).cast("string")))
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], size.alias("_bytes_of"), key_bits(F.col(key)).alias("_h1"), _bits_of(second).alias("_h2"))
    sized = stored(rows.select("_h1", "_h2", F.col("_bytes_of").alias("_bytes")))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(_HALF, max(1, -(-total // limit)).bit_length() + _SPARE_BITS)
    levels, from_bits, open_rows = [], 0, sized
    while True:
        fine = open_rows.select(*_prefix(F.lit(bits)), "_bytes", "_h1", "_h2").groupBy("_p1", "_p2")
        fine = stored(fine.agg(F.sum("_bytes").alias("_bytes"), F.min("_h1").alias("_low1"), F.max("_h1").alias("_high1"), F.min("_h2").alias("_low2"), F.max("_h2").alias("_high2")))
        found = stored(_directory(fine, bits, from_bits, limit))
        levels.append((bits, found))
        left = stored(fine.select("_p1", "_p2").join(found, ["_p1", "_p2"], "left_anti"))
        if bits >= _BITS or left.isEmpty():
            break
        open_rows = open_rows.select("*", *_prefix(F.lit(bits))).join(left, ["_p1", "_p2"], "left_semi").select("_bytes", "_h1", "_h2")
        from_bits, bits = bits + 1, min(_BITS, bits + _MORE_BITS)
    depth, shard_bytes = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (bits, found) in enumerate(levels):
        place = found.select(F.col("_p1").alias(f"_a{i}"), F.col("_p2").alias(f"_b{i}"), F.col("_depth").alias(f"_d{i}"), F.col("_shard_bytes").alias(f"_s{i}"))
        first, second_half = _prefix(F.lit(bits))
        rows = rows.join(place, (first == F.col(f"_a{i}")) & (second_half == F.col(f"_b{i}")), "left")
        depth, shard_bytes = F.coalesce(depth, F.col(f"_d{i}")), F.coalesce(shard_bytes, F.col(f"_s{i}"))
    written = F.concat(F.lpad(F.bin("_h1"), _HALF, "0"), F.lpad(F.bin("_h2"), _HALF, "0"))
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)],
        F.substring(written, F.lit(1), depth).alias("shard"), depth.alias("depth"), F.col("_bytes_of").alias("n_bytes"), shard_bytes.alias("shard_bytes"),
    )


def write(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """One folder per shard under ``path``, each with the shard's rows as Parquet."""
    made = assign(df, limit, key, text)
    made.repartition("shard").write.partitionBy("shard").parquet(path)
