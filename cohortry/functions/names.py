"""Identifier clean-up."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that become "_" and the part that is removed.
UNSAFE_CHARACTERS = "/ -,"
PARENTHESISED = r"\([^)]*\)"


def quoted(name: str) -> Column:
    """Column whose name may hold dots, spaces or signs (names made from data values)."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_name(name: Column | str) -> Column:
    """Column form: unsafe characters to ``_``, bracketed text removed, lower case."""
    column = F.col(name) if isinstance(name, str) else name
    swapped = F.translate(column, UNSAFE_CHARACTERS, "_" * len(UNSAFE_CHARACTERS))
    return F.lower(F.regexp_replace(swapped, PARENTHESISED, ""))


def clean_text(name: str) -> str:
    """The same rule for one column name on the driver."""
    swapped = name.translate(str.maketrans(UNSAFE_CHARACTERS, "_" * len(UNSAFE_CHARACTERS)))
    return re.sub(PARENTHESISED, "", swapped).lower()


def clean_unique(names: Iterable[str]) -> dict[str, str]:
    """``raw -> clean`` for a set of headers; two headers with one clean name are an error."""
    cleaned: dict[str, str] = {}
    for raw in names:
        clean = clean_text(raw)
        if clean in cleaned.values() and cleaned.get(raw) != clean:
            raise ValueError(f"two category names become {clean!r}")
        cleaned[raw] = clean
    return cleaned
