"""One row per key.

The row is picked by ``min_by``/``max_by``, so every map task sends at most one
row per key: a key that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_one(
    df: DataFrame, keys: Sequence[str], order: str, keep: str = "lowest", ties: Sequence[str] = ()
) -> DataFrame:
    """The row with the lowest (or highest) ``order`` per key; NULL counts as last either way.

    Equal rows are told apart by ``ties``, in the same direction.
    """
    if keep not in ("lowest", "highest"):
        raise ValueError(f"keep is 'lowest' or 'highest', not {keep!r}")
    rest = [name for name in df.columns if name not in keys]
    if keep == "lowest":
        picked = F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order, *ties))
    else:
        picked = F.max_by(F.struct(*rest), F.struct(order, *ties))
    return df.groupBy(*keys).agg(picked.alias("picked")).select(*keys, "picked.*").select(df.columns)


def keep_any(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Some row per key."""
    return df.dropDuplicates(list(keys))
