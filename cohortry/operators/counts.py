"""Counts over strata.

The subjects are read once, into ``cells``: one row per combination of race, age
band and sex with the number of subjects and of each flag. That table is as small as
the product of the level lists, whatever the number of subjects, and every
count, proportion and total is a further sum over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import stored

# Label of the row over all strata.
ALL = "ALL"


def cells(
    subjects: DataFrame, by: Sequence[str], flags: Sequence[str], scope: Column | None = None
) -> DataFrame:
    """Subjects and flagged subjects per combination of ``by``.

    With ``scope`` only subjects inside it are counted, but combinations seen
    only outside it stay, with zero counts.
    """
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    return subjects.groupBy(*by).agg(
        F.count_if(inside).alias("n"),
        *(F.sum(F.when(inside, F.col(name)).otherwise(0)).cast("long").alias(name) for name in flags),
    )


def with_total(table: DataFrame, stratum: str, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per stratum and over all strata (row ``ALL``) in one pass."""
    sets = [[F.col(stratum), *map(F.col, by)], [F.col(name) for name in by]]
    summed = table.groupingSets(sets, stratum, *by).agg(
        F.grouping(stratum).alias("over_all"), *(F.sum(name).alias(f"total_{name}") for name in sums)
    )
    label = F.when(F.col("over_all") == 1, F.lit(ALL)).otherwise(F.col(stratum))
    return summed.select(label.alias("stratum"), *by, *(F.col(f"total_{name}").alias(name) for name in sums))


def level_counts(table: DataFrame, dimensions: Sequence[str], stratum: str = "race") -> DataFrame:
    """``stratum, dimension, level, n`` for each dimension, total row included."""
    stacked = table.unpivot([stratum, "n"], list(dimensions), "dimension", "level")
    return with_total(stacked, stratum, ["dimension", "level"], ["n"])


def flag_counts(table: DataFrame, flags: Sequence[str], stratum: str = "race") -> DataFrame:
    """``stratum, level, n``: flagged subjects, one row per flag, total row included."""
    return with_total(table, stratum, [], flags).unpivot(["stratum"], list(flags), "level", "n")


def metrics(
    table: DataFrame, dimensions: Sequence[str], groups: dict[str, Sequence[str]], stratum: str = "race"
) -> DataFrame:
    """Every count the reports use, long: ``stratum, dimension, level, n``.

    ``groups`` names the flags counted under each dimension label. Dimension
    ``everyone`` holds the sizes of the strata.
    """

    def entry(dimension: str, level: Column, n: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), level.alias("level"), n.alias("n"))

    entries = [entry("everyone", F.lit(""), F.col("n"))]
    entries += [entry(name, F.col(name), F.col("n")) for name in dimensions]
    entries += [entry(label, F.lit(flag), F.col(flag)) for label, flags in groups.items() for flag in flags]
    stacked = table.select(stratum, F.inline(F.array(*entries)))
    return with_total(stacked, stratum, ["dimension", "level"], ["n"])


def level_lists(table: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``dimension, level``: the distinct levels of each dimension."""
    seen = table.select(*dimensions).distinct()
    return seen.unpivot([], list(dimensions), "dimension", "level").distinct()


def complete(counts: DataFrame) -> DataFrame:
    """Adds a zero row for every level of a dimension that a stratum lacks.

    Works on the rows of a report. Every level list is joined to the strata of its
    dimension, so the result has a row per stratum and level, which is what is asked for.
    """
    known = stored(counts.where(F.col("level").isNotNull()).select("stratum", "dimension", "level", "n"))
    levels = known.select("dimension", "level").distinct()
    grid = known.select("stratum", "dimension").distinct().join(levels, "dimension")
    filled = grid.join(known, ["stratum", "dimension", "level"], "left")
    return filled.select("stratum", "dimension", "level", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def drop_small_everywhere(table: DataFrame, by: str, value: str, least: float) -> DataFrame:
    """Drops a category whose value is below ``least`` in every stratum."""
    largest = F.max(value).over(Window.partitionBy(by))
    return table.withColumn("largest", largest).where(F.col("largest") >= least).drop("largest")
