"""Design tables for the regressions: dummy columns, reference levels, support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.names import quoted


def patterns(subjects: DataFrame, by: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """One row per covariate pattern with subjects ``n`` and the events of each outcome.

    The likelihood depends on the data through these sums alone.
    """
    return subjects.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.sum(name).cast("long").alias(name) for name in outcomes)
    )


def level_support(table: DataFrame, stratum: str, variables: Sequence[str]) -> dict[str, dict[tuple[str, str], int]]:
    """Per stratum, the subjects of each ``(variable, level)`` of a pattern table.

    One row per stratum and level reaches the driver: the columns that the design will have.
    """
    stacked = table.unpivot([stratum, "n"], list(variables), "variable", "level")
    counted = stacked.groupBy(stratum, "variable", "level").agg(F.sum("n").alias("n"))
    found: dict[str, dict[tuple[str, str], int]] = {}
    for row in counted.where(F.col("level").isNotNull()).collect():
        found.setdefault(row[stratum], {})[row["variable"], row["level"]] = row["n"]
    return found


def dummies(table: DataFrame, levels: dict[str, list[str]], keep: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """0/1 columns ``variable_level`` beside the ``keep`` columns and an intercept.

    Names in ``drop`` (the reference levels) are left out; absent names are ignored.
    """
    made = {f"{variable}_{level}": (variable, level) for variable, values in levels.items() for level in values}
    columns = [
        (F.col(variable) == level).cast("int").alias(name)
        for name, (variable, level) in made.items()
        if name not in drop
    ]
    return table.select(*keep, F.lit(1).alias("intercept"), *columns)


def dummy_names(levels: dict[str, list[str]], drop: Sequence[str] = ()) -> list[str]:
    names = [f"{variable}_{level}" for variable, values in levels.items() for level in values]
    return [name for name in names if name not in drop]


def support(table: DataFrame, flags: Sequence[str], stratum: str = "race") -> DataFrame:
    """``stratum, term, support``: how many subjects of the stratum have each flag."""
    weight = F.col("n") if "n" in table.columns else F.lit(1)
    sums = table.groupBy(F.col(stratum).alias("stratum")).agg(
        *(F.sum(quoted(flag) * weight).cast("long").alias(flag) for flag in flags)
    )
    return sums.unpivot(["stratum"], [quoted(flag) for flag in flags], "term", "support")


def supported(table: DataFrame, more_than: int, drop: Sequence[str] = ()) -> DataFrame:
    """Terms with enough support in their stratum, without the dropped names."""
    return table.where((F.col("support") > more_than) & ~F.col("term").isin(list(drop)))
