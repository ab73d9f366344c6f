"""Numeric banding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lowest age, highest age or None, label).
AGE_BANDS: tuple[tuple[int, int | None, str], ...] = (
    (0, 0, "0"),
    (1, 11, "1-11"),
    (12, 17, "12-17"),
    (18, 34, "18-34"),
    (35, 49, "35-49"),
    (50, None, "50+"),
)


def band(value: Column, bands: Sequence[tuple[int, int | None, str]] = AGE_BANDS) -> Column:
    """Label of the band a number falls in; NULL outside every band."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        inside = value >= low if high is None else value.between(low, high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


def whole_number(value: Column) -> Column:
    """Integer value of a text column; NULL where the text is not an integer."""
    return value.try_cast("int")
