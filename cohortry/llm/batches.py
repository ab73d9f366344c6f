"""Columns computed in Python from a text column, one Arrow batch after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python step handles at once: bounds its memory whatever the batch holds.
SLICE_ROWS = 512


def add_columns(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType]],
    compute: Callable[[pa.Array], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from the text column ``text``.

    ``compute`` gets at most ``SLICE_ROWS`` texts and returns one array per field.
    ``keep`` names the columns to return beside the new ones (all by default);
    others are not sent to Python. A kept column named like a new one gives way to it.
    """
    names = {name.lower() for name, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    sent = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    schema = T.StructType([T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(kept)])
    for i, (_, kind) in enumerate(fields):
        schema.add(f"_n{i}", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                made = compute(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=schema.names)

    made = sent.mapInArrow(run, schema)
    return made.toDF(*kept, *[name for name, _ in fields])
