"""Queries, row iterators and writes over tables, files and JDBC databases."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def query(spark: SparkSession, text: str, values: dict | list | None = None) -> DataFrame:
    """Result of a SQL text; ``values`` fills its ``:name`` or ``?`` markers."""
    return spark.sql(text, args=values) if values else spark.sql(text)


def execute(spark: SparkSession, statement: str, values: dict | list | None = None) -> bool:
    """Run a statement for its effect (insert, create table as select, drop); Spark runs it at once."""
    query(spark, statement, values)
    return True


def rows(df: DataFrame) -> Iterator[Row]:
    """Rows one at a time; the driver holds one partition and fetches the next meanwhile."""
    return df.toLocalIterator(prefetchPartitions=True)


def row_chunks(df: DataFrame, chunks: int = 100) -> Iterator[list[Row]]:
    """Rows in lists of ``chunks``."""
    stream = rows(df)
    while chunk := list(islice(stream, chunks)):
        yield chunk


@dataclass(frozen=True)
class KeyRanges:
    """Integer key column split into ``count`` ranges for a parallel JDBC read.

    Only the stride comes from the bounds. The first and last ranges are open,
    so keys below, at and above the bounds, and NULL keys, are all read.
    """

    column: str
    lowest: int
    highest: int
    count: int


def max_key(df: DataFrame, column: str) -> DataFrame:
    """One row with the largest integer value of a key held as text."""
    return df.agg(F.max(F.col(column).try_cast("long")).alias("max_id"))


def key_ranges(df: DataFrame, column: str, width: int = 1000, most: int = 10_000) -> KeyRanges:
    """Ranges of about ``width`` keys; wider ones when more than ``most`` would be needed."""
    key = F.col(column).try_cast("long")
    low, high = df.agg(F.min(key), F.max(key)).first()
    low, high = (0, 0) if low is None else (low, high)
    return KeyRanges(column, low, high + 1, max(1, min(most, math.ceil((high + 1 - low) / width))))


def balanced_bounds(df: DataFrame, column: str, count: int, accuracy: int = 10_000) -> list[int]:
    """Keys at which ``count`` ranges of about equally many rows begin, from the second range on.

    They come from a quantile sketch, merged over tasks, so gaps and dense stretches of keys make no range heavier than
    others; only one key's own rows cannot be parted. ``accuracy`` is the sketch's: a bound is off by at most rows / accuracy.
    """
    key = F.col(column).try_cast("long")
    shares = [i / count for i in range(1, count)]
    found = df.agg(F.percentile_approx(key, shares, accuracy).alias("bounds")).first()["bounds"] if shares else []
    return sorted(set(found or []))


def range_number(column: str, bounds: list[int]) -> Column:
    """Which range a key is in: 0 below the first bound and for a key that is no integer."""
    key = F.col(column).try_cast("long")
    return F.coalesce(F.size(F.filter(F.lit(bounds), lambda bound: bound <= key)), F.lit(0)) if bounds else F.lit(0)


def range_predicates(column: str, bounds: list[int]) -> list[str]:
    """One SQL condition per range for a parallel JDBC read (``spark.read.jdbc(..., predicates=...)``); null keys are in the first."""
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {low} and {column} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} or {column} is null", *inner, f"{column} >= {bounds[-1]}"]


def jdbc_options(
    url: str,
    table: str | None = None,
    sql: str | None = None,
    ranges: KeyRanges | None = None,
    fetch_rows: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC read of a table or a query, parallel when ``ranges`` is given."""
    if (table is None) == (sql is None):
        raise ValueError("give a table or a query")
    options = {"url": url, "fetchsize": str(fetch_rows), "dbtable": table or f"({sql}) q", **extra}
    if ranges is not None:
        options |= {
            "partitionColumn": ranges.column,
            "lowerBound": str(ranges.lowest),
            "upperBound": str(ranges.highest),
            "numPartitions": str(ranges.count),
        }
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, predicates: list[str], fetch_rows: int = 10_000, **extra: str) -> DataFrame:
    """A parallel JDBC read with one task per condition, as from ``range_predicates``."""
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch_rows), **extra})


def append_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 10_000, **extra: str) -> None:
    """Bulk append; every partition writes its own batches."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_rows), **extra).mode("append").save()


def append_table(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def append_files(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def key_between(column: str, low: int, high: int) -> Column:
    """Half-open integer range test on a key held as text."""
    key = F.col(column).try_cast("long")
    return (key >= low) & (key < high)
