"""Log files as line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the separator between time, logger name, level and message.
FIELD_SEPARATOR = " - "


def latest_log(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """Lines of the file whose name sorts last, with the file they come from.

    The name is found from the file listing alone; the lines of the other files
    are not read.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    newest = listing.agg(F.max("path")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return spark.read.text(newest).select(F.lit(newest).alias("file"), "value")


def log_fields(line: Column) -> list[Column]:
    """``logged_at, logger, level, message`` of a line; the message may hold the separator."""
    parts = F.split(line, FIELD_SEPARATOR, 4)
    return [F.get(parts, i).alias(name) for i, name in enumerate(("logged_at", "logger", "level", "message"))]
