"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a fixed shuffled order. A document's virtual finish
time is the number of its source's words up to and with it, divided by the source's
target; a source whose target exceeds its words goes through them again. All
copies are taken in the order of their finish times until the budget is used up, so at any
cut every source has had its share.

Running totals never pass through one task: rows fall into buckets by a prefix of
their order (a hash, or the finish time), bucket totals are summed up, and each bucket
counts on from there. A bucket holds about ``BUCKET_ROWS`` rows whatever the size of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import stored

#: Rows that share a bucket of a running total.
BUCKET_ROWS = 4096
#: No document is taken more often than this.
MOST_EPOCHS = 3
_BITS = 48
_NO_KEY = -(2**63)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks (space, and tab to carriage return); null has none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def shuffle_key(key: Column, seed: str) -> Column:
    """48 bits that place a document in its source's order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Column | None = None, cap: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): all words shared out by weight.

    Sources in the order of their code points, null last, weigh 1, 2, 3 and so on over again unless ``weights``
    (a column over ``place``, counted from 0) says otherwise. A target stops at ``cap`` times its source; what is over
    goes to the others by weight. One row per source is all this sorts.
    """
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumn("weight", (F.col("place") % 3 + 1 if weights is None else weights).cast("double"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    filled = placed.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("weight").over(after))
    # the first source, by what a unit of weight would fill, that its share does not fill sets the level
    free = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    spot = F.row_number().over(by_ratio)
    filled = filled.withColumn("spot", F.when(free, spot))
    level = F.min_by("level", "spot").over(every)
    share = F.coalesce(level * F.col("weight"), F.lit(0.0))
    full = F.col("source_size") * F.lit(float(cap))
    return filled.select("source", "source_size", F.least(share, full).alias("target"))


def _bucket_bits(rows: int) -> int:
    return max(0, (max(rows, 1) // BUCKET_ROWS).bit_length())


def shares(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Column | None = None, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """One row per row of ``df``: key, sum (a hash of the text), source, size, source_size, target, copies and taken.

    ``budget`` is the mix's size as a share of all words. ``copies`` says how often the mix
    takes the row, ``taken`` how many words that is. A null source is a source; a null key stands first
    in its source's order; a null or blank text has size 0 and is not taken; repeated rows are taken
    one by one. Ties of the finish time go by source, epoch and shuffled order. The same rows give the same
    mix in every run. An empty table gives an empty result; other columns play no part.
    """
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("sum"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    rows = stored(rows.withColumn("h", shuffle_key(F.col("doc"), seed)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights).withColumn("target", F.col("target") * budget))
    bits = _bucket_bits(rows.count())

    same = F.col("source").eqNullSafe(F.col("_source"))
    bucketed = rows.withColumn("bucket", F.shiftright("h", _BITS - bits))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    offsets = totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), ahead.alias("ahead"))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc", "size", "sum").rowsBetween(Window.unboundedPreceding, 0)
    counted = bucketed.join(stored(offsets), same & (F.col("bucket") == F.col("_bucket"))).withColumn("upto", F.col("ahead") + F.sum("size").over(order))
    counted = counted.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    counted = counted.select("doc", "sum", "source", "size", "h", "upto", "source_size", "target")

    epochs = F.when(F.col("size") > 0, F.least(F.lit(MOST_EPOCHS), F.ceil(F.col("target") / F.col("source_size")) + 1)).otherwise(1).cast("int")
    finish = F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    queued = counted.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("finish", finish)
    # Sources end together at finish time 1; what can end past it by a document's length keeps its place in the last bucket.
    spots = 2**bits
    queued = stored(queued.withColumn("bucket", F.when(F.col("finish").isNotNull() & (F.col("size") > 0), F.least(F.floor(F.col("finish") * spots), F.lit(4 * spots)))))
    waiting = queued.where("bucket is not null")
    totals = waiting.groupBy("bucket").agg(F.sum("size").alias("words"))
    # one row per bucket
    ahead = F.sum("words").over(Window.orderBy("bucket")) - F.col("words")
    offsets = stored(totals.select("bucket", ahead.alias("ahead"), "words"))
    limit = goals.agg(F.round(F.sum("target")).cast("long").alias("limit")).first()["limit"] or 0
    # Only the bucket that the budget ends in needs its rows in order.
    cut = offsets.where(F.col("ahead") + F.col("words") > limit).agg(F.min("bucket")).first()[0]
    if cut is None:
        kept = F.lit(True)
        placed = queued.withColumn("within", F.lit(0).cast("long"))
    else:
        start = offsets.where(F.col("bucket") == cut).first()["ahead"]
        within = Window.partitionBy("bucket").orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "h", "doc", "upto").rowsBetween(Window.unboundedPreceding, 0)
        last = queued.where(F.col("bucket") == cut).withColumn("within", F.sum("size").over(within) + start)
        rest = queued.where(F.col("bucket").isNull() | (F.col("bucket") != cut)).withColumn("within", F.when(F.col("bucket") < cut, F.lit(0)).otherwise(limit + 1).cast("long"))
        placed, kept = rest.unionByName(last), F.col("within") <= limit
    copies = F.sum((F.col("bucket").isNotNull() & kept).cast("int"))
    # a row with words is known by where its source's count stands after it
    whole = placed.where("size > 0").groupBy("doc", "sum", "source", "size", "upto", "source_size", "target").agg(copies.alias("copies"))
    none = placed.where("size = 0").select("doc", "sum", "source", "size", "upto", "source_size", "target", F.lit(0).cast("long").alias("copies"))
    made = whole.unionByName(none)
    return made.select(F.col("doc").alias(key), "sum", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Column | None = None, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """The rows of the mix, with the columns of ``df``: a row taken twice stands twice, one not taken is left out.

    Of rows with equal key and text those of the smallest hash over all columns are the ones repeated. See ``shares`` for everything else.
    """
    doc = F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY))
    taken = shares(df, key, text, source, weights, budget, seed).groupBy(doc.alias("_doc"), F.col("sum").alias("_sum"))
    taken = stored(taken.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0"))
    names = df.columns
    side = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], doc.alias("_doc"), F.xxhash64(F.col(text)).alias("_sum"))
    met = side.join(taken, ["_doc", "_sum"])
    version = F.xxhash64(*[F.to_json(F.struct(f"_c{i}")) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"_c{i}") for i, c in enumerate(names)])
    place = F.row_number().over(Window.partitionBy("_doc", "_sum").orderBy(version))
    times = F.floor(F.col("_copies") / F.col("_rows")) + (place <= F.col("_copies") % F.col("_rows")).cast("long")
    repeated = met.withColumn("_times", times).where("_times > 0").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return repeated.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
