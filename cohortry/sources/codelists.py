"""Category maps and code lists.

A category map has ``value, category``; a NULL category leaves the value out of
the study. A code list has ``kind, category, code``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.names import clean_name, clean_unique
from cohortry.session import local_frame, rows_up_to


# A code list of at most this many rows is also held on the driver, and broadcast.
FEW_CODES = 10_000


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, category string").csv(path, header=True)


def read_wide_codes(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with one column per category. All text: ``303.90`` has to stay ``303.90``."""
    return spark.read.csv(path, header=True, inferSchema=False)


def long_codes(wide: DataFrame, kind: str) -> DataFrame:
    """``kind, category, code`` rows of a wide, ragged code table."""
    names = clean_unique(wide.columns)
    renamed = wide.select([F.col(f"`{raw}`").cast("string").alias(name) for raw, name in names.items()])
    return (
        renamed.unpivot([], list(renamed.columns), "category", "code")
        .where(F.col("code").isNotNull())
        .select(F.lit(kind).alias("kind"), "category", "code")
        .distinct()
    )


def combined(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def category_names(codes: DataFrame, raw: str = "category") -> DataFrame:
    """Distinct ``kind, raw_name, name`` of a long code list."""
    return codes.select("kind", F.col(raw).alias("raw_name"), clean_name(F.col(raw)).alias("name")).distinct()


def _once(headers: list[str]) -> list[str]:
    """The headers; one that stands in two lists would be one column for two categories."""
    twice = sorted({name for name in headers if headers.count(name) > 1})
    if twice:
        raise ValueError(f"categories of the same name: {twice}")
    return headers


@dataclass(frozen=True)
class CodeList:
    """A code list whose category names are known on the driver.

    ``categories`` maps kind to category names: one output column each.
    ``codes`` is the long table, of any size.
    ``known`` holds the same rows on the driver when there are few of them.
    ``headers`` maps each category name to the header it was made from.
    """

    categories: dict[str, tuple[str, ...]]
    codes: DataFrame
    known: tuple[tuple[str, str, str], ...] | None = None
    headers: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def names(self) -> list[str]:
        return [name for names in self.categories.values() for name in names]

    @classmethod
    def of(cls, spark: SparkSession, lists: dict[str, dict[str, list[str]]]) -> CodeList:
        """From ``{kind: {category: [code, ...]}}``."""
        clean = clean_unique(_once([raw for named in lists.values() for raw in named]))
        rows = tuple(
            (kind, clean[raw], code) for kind, named in lists.items() for raw, codes in named.items() for code in codes
        )
        text = {name: pa.string() for name in ("kind", "category", "code")}
        columns = {name: [row[i] for row in rows] for i, name in enumerate(text)}
        return cls(
            {kind: tuple(clean[raw] for raw in named) for kind, named in lists.items()},
            local_frame(spark, columns, text),
            rows if len(rows) <= FEW_CODES else None,
            {name: raw for raw, name in clean.items()},
        )

    @classmethod
    def read(cls, spark: SparkSession, paths: dict[str, str], few: int = FEW_CODES) -> CodeList:
        """From one wide CSV per kind."""
        wide = {kind: read_wide_codes(spark, path) for kind, path in paths.items()}
        clean = clean_unique(_once([raw for table in wide.values() for raw in table.columns]))
        codes = combined(*(long_codes(table, kind) for kind, table in wide.items()))
        found = rows_up_to(codes, few)
        return cls(
            {kind: tuple(clean[raw] for raw in table.columns) for kind, table in wide.items()},
            codes,
            None if found is None else tuple(sorted(tuple(row) for row in found)),
            {name: raw for raw, name in clean.items()},
        )
