"""Category-map filters, exclusions and relabelling."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from cohortry.session import local_frame, rows_up_to

CategoryMap = dict[str, str | None] | DataFrame

# A map up to this size becomes an expression inside the scan's filter and
# projection. A larger one is joined, and Catalyst picks the join.
EXPRESSION_ROWS = 200


def mapped_values(categories: CategoryMap) -> dict[str, str] | DataFrame:
    """The map without excluded values: a dict when small, else ``value, category`` rows."""
    if isinstance(categories, dict):
        return {value: category for value, category in categories.items() if category is not None}
    kept = (
        categories.where(F.col("value").isNotNull() & F.col("category").isNotNull())
        .groupBy("value")
        .agg(F.min("category").alias("category"))
    )
    found = rows_up_to(kept, EXPRESSION_ROWS)
    return kept if found is None else {row["value"]: row["category"] for row in found}


def _as_frame(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    columns = {"value": list(pairs), "category": list(pairs.values())}
    return local_frame(df.sparkSession, columns, {"value": pa.string(), "category": pa.string()})


def _beside(df: DataFrame, pairs: dict[str, str] | DataFrame) -> tuple[DataFrame, str, str]:
    """The map as a frame whose two column names no column of ``df`` has."""
    frame = _as_frame(df, pairs) if isinstance(pairs, dict) else pairs
    taken = {name.lower() for name in df.columns}
    mark = "_"
    while {f"{mark}value", f"{mark}category"} & taken:
        mark += "_"
    value, category = f"{mark}value", f"{mark}category"
    return frame.select(F.col("value").alias(value), F.col("category").alias(category)), value, category


def keep_members(df: DataFrame, column: str, categories: CategoryMap) -> DataFrame:
    """Rows whose value is in the map with a category; compared as text."""
    pairs = mapped_values(categories)
    kind = df.schema[column].dataType
    text = F.col(column) if isinstance(kind, StringType) else F.col(column).cast("string")
    if isinstance(pairs, dict) and len(pairs) <= EXPRESSION_ROWS:
        if isinstance(kind, IntegralType):
            # Integers in the filter, not a cast of the column, so that it reaches the scan.
            whole = [int(value) for value in pairs if re.fullmatch(r"0|-?[1-9]\d*", value)]
            return df.where(F.col(column).isin(whole))
        return df.where(text.isin(list(pairs)))
    frame, value, _ = _beside(df, pairs)
    return df.join(frame.select(value), text == F.col(value), "left_semi")


def relabel(df: DataFrame, column: str, categories: CategoryMap) -> DataFrame:
    """Each value replaced by its category in one pass; other values stay as they are."""
    pairs = mapped_values(categories)
    order = df.columns
    text = df.withColumn(column, F.col(column).cast("string"))
    if isinstance(pairs, dict) and len(pairs) <= EXPRESSION_ROWS:
        return text.replace(pairs, subset=[column]) if pairs else text
    frame, value, category = _beside(df, pairs)
    joined = text.join(frame, F.col(f"`{column}`") == F.col(value), "left")
    return joined.withColumn(column, F.coalesce(F.col(category), F.col(f"`{column}`"))).select([f"`{name}`" for name in order])


def exclude(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows left after dropping every ``column = value``; NULL equals no value, so it stays."""
    for column, value in pairs:
        df = df.where(~F.col(column).eqNullSafe(F.lit(value)))
    return df
