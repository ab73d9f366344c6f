"""Reports over log lines (``value`` column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import stored
from cohortry.sources.logs import log_fields

# The marks searched for and the shape of a timing message.
ERROR_MARK = "ERROR"
TIMING_MARK = "seconds"
TIMED_FUNCTION = r"function\s+(\S+)\s+\S+\s+(\S+)"
BAR_STEPS = 30
BAR_MARK = "▥"


def parsed(lines: DataFrame) -> DataFrame:
    return lines.select(*log_fields(F.col("value")))


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").contains(ERROR_MARK))


def timing_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").contains(TIMING_MARK))


def function_times(lines: DataFrame) -> DataFrame:
    """``fn, n, total, average`` of the seconds logged per function.

    Seconds are added as decimals: the total is exact and does not depend on the
    order in which partitions are combined.
    """
    timed = timing_lines(lines).select(
        F.regexp_extract("value", TIMED_FUNCTION, 1).alias("fn"),
        F.regexp_extract("value", TIMED_FUNCTION, 2).try_cast("decimal(28,12)").alias("seconds"),
    )
    summed = (
        timed.where(F.col("fn") != "").groupBy("fn").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    )
    total = F.col("seconds").cast("double")
    return summed.select("fn", "n", total.alias("total"), (total / F.col("n")).alias("average"))


def with_bars(times: DataFrame) -> DataFrame:
    """Adds ``steps`` (0 to 30, 30 for the slowest average) and the drawn ``bar``.

    The times are needed twice, so the few rows are stored first and the log is read once.
    """
    times = stored(times)
    slowest = times.agg(F.max("average")).scalar()
    steps = F.floor(F.try_divide(F.lit(BAR_STEPS) * F.col("average"), slowest)).cast("int")
    return times.withColumn("steps", F.coalesce(steps, F.lit(0))).withColumn(
        "bar", F.rpad(F.repeat(F.lit(BAR_MARK), F.col("steps")), BAR_STEPS, " ")
    )


def report_lines(times: DataFrame) -> DataFrame:
    """The bars as fixed-width text."""
    return with_bars(times).select(
        F.format_string("%40s %10d %7.2f %10.2e [%s]", "fn", "n", "total", "average", "bar").alias("line")
    )
