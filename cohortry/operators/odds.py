"""Crude (one-factor) odds ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.stats import log_odds_bounds, two_by_two


def crude_odds_ratios(
    subjects: DataFrame, flags: Sequence[str], outcome: str, stratum: str = "race", level: float = 0.95
) -> DataFrame:
    """Odds ratio of a 0/1 outcome for each 0/1 flag, per stratum.

    One aggregate of the subjects gives the margins of every 2x2 table at once.
    """
    sums = subjects.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"),
        F.sum(outcome).cast("long").alias("events"),
        *(F.sum(flag).cast("long").alias(f"{flag}_n") for flag in flags),
        *(F.sum(F.col(flag) * F.col(outcome)).cast("long").alias(f"{flag}_events") for flag in flags),
    )
    entries = [
        F.struct(
            F.lit(flag).alias("term"),
            F.col(f"{flag}_events").alias("a"),
            (F.col(f"{flag}_n") - F.col(f"{flag}_events")).alias("b"),
            (F.col("events") - F.col(f"{flag}_events")).alias("c"),
            (F.col("n") - F.col("events") - F.col(f"{flag}_n") + F.col(f"{flag}_events")).alias("d"),
        )
        for flag in flags
    ]
    tables = sums.select("stratum", "n", F.inline(F.array(*entries)))
    log_odds, error = two_by_two(*(F.col(cell) for cell in "abcd"))
    ratio, low, high = log_odds_bounds(log_odds, error, level)
    return tables.select("stratum", "term", "n", "a", "b", "c", "d", ratio.alias("or_"), low.alias("lo"), high.alias("hi"))
