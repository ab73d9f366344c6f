"""The smallest combination of several columns per key, compared as one number."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortry.operators.membership import EXPRESSION_ROWS

_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


class Packed:
    """Columns packed into one bigint that orders as they do, nulls first.

    Integers are counted from the least of their type, texts by their place among all values they may
    have; each column gets as many numbers as its type or its list has values, and one for null.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], listed: Mapping[str, Sequence[str]]) -> None:
        self.columns, self.values, self.sizes, self.lowest = list(columns), {}, [], {}
        for name in columns:
            kind = df.schema[name].dataType
            if kind.simpleString() in _BITS:
                bits = _BITS[kind.simpleString()]
                self.lowest[name] = (-(2 ** (bits - 1)), kind)
                self.sizes.append(2**bits + 1)
            else:
                self.values[name] = sorted(listed[name], key=str.encode)
                self.sizes.append(len(listed[name]) + 1)

    @staticmethod
    def fits(df: DataFrame, columns: Sequence[str], listed: Mapping[str, Sequence[str]]) -> bool:
        """Whether the types and lists prove that every combination has a number."""
        size = 1
        for name in columns:
            kind = df.schema[name].dataType
            if kind.simpleString() in _BITS:
                size *= 2 ** _BITS[kind.simpleString()] + 1
            elif kind == StringType() and len(listed.get(name, range(EXPRESSION_ROWS + 1))) <= EXPRESSION_ROWS:
                size *= len(listed[name]) + 1
            else:
                return False
        return size < 2**63

    def number(self) -> Column:
        total = None
        for name, size in zip(self.columns, self.sizes, strict=True):
            column = F.col(f"`{name}`")
            if name in self.lowest:
                place = column.cast("bigint") + F.lit(1 - self.lowest[name][0])
            else:
                place = F.array_position(F.array(*map(F.lit, self.values[name])).cast("array<string>"), column)
            place = F.coalesce(place, F.lit(0)).cast("bigint")
            total = place if total is None else total * size + place
        return total

    def column(self, number: Column, name: str) -> Column:
        """What ``name`` was in a number."""
        at = self.columns.index(name)
        if at + 1 < len(self.sizes):
            number = F.call_function("div", number, F.lit(math.prod(self.sizes[at + 1 :])).cast("bigint"))
        place = number % self.sizes[at]
        if name in self.values:
            return F.get(F.array(F.lit(None), *map(F.lit, self.values[name])).cast("array<string>"), place.cast("int"))
        low, kind = self.lowest[name]
        return F.when(place > 0, (place - (1 - low)).cast(kind))


def least(df: DataFrame, keys: Sequence[str], columns: Sequence[str], wanted: Sequence[str], listed: Mapping[str, Sequence[str]]) -> DataFrame:
    """``keys`` and the ``wanted`` columns of each key's smallest combination of ``columns``, nulls first.

    ``listed`` has all values that a text column may hold in ``df``. Where types and lists prove that a combination
    fits a bigint, rows are combined in a hash aggregate before the shuffle; else as structs, which Spark sorts
    (a decimal for wider combinations was measured to be slower than that).
    """
    if Packed.fits(df, columns, listed):
        packed = Packed(df, columns, listed)
        taken = {name.lower() for name in df.columns}
        mark = "_least"
        while mark in taken:
            mark += "_"
        found = df.select(*keys, packed.number().alias(mark)).groupBy(*keys).agg(F.min(mark).alias(mark))
        return found.select(*keys, *[packed.column(F.col(mark), name).alias(name) for name in wanted])
    first = F.min(F.struct(*columns)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[f"first.{name}" for name in wanted])
