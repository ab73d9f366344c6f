"""Inner joins with the keys and filters of each side given apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_where: Column | None = None,
    right_where: Column | None = None,
) -> DataFrame:
    """Inner join on differently named keys after filtering each side.

    The right side's keys are dropped: they equal the left side's.
    """
    left = left if left_where is None else left.where(left_where)
    right = right if right_where is None else right.where(right_where)
    condition = [left[a] == right[b] for a, b in on]
    return left.join(right, condition).drop(*(right[b] for _, b in on))


def with_text_key(df: DataFrame, *keys: str) -> DataFrame:
    """Keys as text, so tables that hold them as numbers and as text can be joined."""
    return df.withColumns({key: F.col(key).cast("string") for key in keys})


def renamed_keys(df: DataFrame, names: Sequence[str], to: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(names, to, strict=True)))
