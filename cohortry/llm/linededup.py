"""Boilerplate lines: lines that many distinct sites share.

Every line's distinct sites are estimated by a HyperLogLog sketch per line hash;
sketches of map tasks merge in the aggregation, so a line that stands everywhere
costs a sketch per task. Lines whose estimate is near the threshold get an exact
count of distinct sites. What then has at least ``min_sites`` sites is
removed from all documents. A line's rows are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import stored

_NO_KEY = -(2**63)


@dataclass(frozen=True)
class Settings:
    min_sites: int = 5
    sketch_bits: int = 12

    @property
    def margin(self) -> float:
        """Four standard errors of the sketch, as a share of the estimate."""
        return 4 * 1.04 / 2 ** (self.sketch_bits / 2)


def _lines(df: DataFrame, *keys: str) -> DataFrame:
    """Lines that are not blank, by 96 hash bits of the line without blanks around it."""
    spread = df.select(*keys, F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("line", F.trim("line"))
    return spread.where(F.col("line") != "").select(*keys, "place", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", settings: Settings = Settings()) -> DataFrame:
    """The written hashes (h1, h2) of the lines with at least ``min_sites`` distinct sites; a null site is no site."""
    s = settings
    rows = df.select(F.col(text).alias("text"), F.col(site).cast("string").alias("site")).where("site is not null")
    lines = _lines(rows, "site").select("h1", "h2", "site")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", s.sketch_bits)).alias("sites"))
    # far below the threshold nothing has to be written
    sketched = stored(sketched.where(F.col("sites") >= s.min_sites * (1 - s.margin) - 1))
    sure = F.col("sites") > s.min_sites * (1 + s.margin) + 1
    unsure = stored(sketched.where(~sure).select("h1", "h2"))
    exact = lines.join(unsure, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return stored(sketched.where(sure).select("h1", "h2").unionByName(exact.where(F.col("n") >= s.min_sites).select("h1", "h2")))


def clean(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", settings: Settings = Settings()) -> DataFrame:
    """``df`` with its boilerplate lines taken out of the text, n_lines (before) and n_removed.

    Lines end at a line feed; a carriage return before it is part of the line. Blanks (not tabs) around a line do not count, lines
    of blanks alone are never boilerplate, and lines kept stay as they are. A null text stays null with no lines, an empty
    text has one empty line. Rows without a site are cleaned but add no
    site. Repeated rows count their site once. Columns named n_lines or n_removed give way. An empty table stays empty.
    """
    doc = F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY))
    rows = df.select(doc.alias("doc"), F.xxhash64(F.col(text)).alias("sum"), F.col(text).alias("text"))
    gone = _lines(rows, "doc", "sum").join(boilerplate(df, text, site, settings), ["h1", "h2"], "left_semi")
    gone = gone.groupBy(F.col("doc").alias("_doc"), F.col("sum").alias("_sum")).agg(F.collect_set("place").alias("_gone"))
    kept = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    side = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], doc.alias("_doc"), F.xxhash64(F.col(text)).alias("_sum"), F.col(text).alias("_text"))
    met = side.join(stored(gone), ["_doc", "_sum"], "left")
    lines = F.split("_text", "\n")
    # a set difference of places: the work grows with the lines, not with lines times removed ones
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    left = F.array_join(F.transform(places, lambda i: lines[i]), "\n")
    cleaned = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left)
    names = {text: cleaned}
    return met.select(
        *[names.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(kept)],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
