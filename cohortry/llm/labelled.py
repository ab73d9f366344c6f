"""What the trained operators gather from labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_counts(
    rows: DataFrame, features: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], buckets: int
) -> tuple[tuple[np.ndarray, np.ndarray], tuple[float, float]]:
    """Of all rows (text, label 0 or 1): in how many texts of each label a bucket occurs, and the number of texts.

    ``features`` gives distinct (row, bucket) pairs of a batch. Each task adds up its
    own batches first, so what is shuffled, and what the driver gets, is bounded by the number of buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets + 1), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                label = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, bucket = features(part.column(0))
                for y in (0, 1):
                    total[y, :buckets] += np.bincount(bucket[label[row] == y], minlength=buckets)
                    total[y, buckets] += int((label == y).sum())
        y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int64()), pa.array(total[y, at], pa.int64())], names=["y", "at", "n"])

    found = rows.select("text", "label").mapInArrow(count, "y int, at long, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((2, buckets + 1), np.float64)
    total[found["y"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    return (total[0, :buckets], total[1, :buckets]), (float(total[0, buckets]), float(total[1, buckets]))


def held_back(sizes: tuple[float, float], docs: int) -> Column:
    """Whether a row (key, text, label) is one of about ``docs`` of its label, a fifth at most, by a hash of key and text."""
    share = F.when(F.col("label") == 1, F.lit(min(0.2, docs / sizes[1]))).otherwise(F.lit(min(0.2, docs / sizes[0])))
    drawn = F.xxhash64(F.lit("held back"), F.col("key").cast("string"), F.col("text"))
    return (drawn.cast("double") + 2.0**63) / 2.0**64 < share


def sample(rows: DataFrame, docs: int, most_bytes: int, label: str = "label") -> tuple[list[str], list]:
    """At most ``docs`` texts of each label, of at most ``most_bytes`` each, the same ones in every run.

    They are the first in the order of a hash of key and text. Only rows whose hash can be among
    the first, about four times ``docs`` of a label, leave their task.
    """
    order = F.xxhash64(F.col("key").cast("string"), "text").alias("_order")
    short = rows.where(F.octet_length("text") <= most_bytes).select("text", F.col(label).alias("_label"), order)
    counts = short.groupBy("_label").count().collect()
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for row in counts for x in (row["_label"], 4.0 * docs / row["count"])])
    near = (F.col("_order").cast("double") + 2.0**63) / 2.0**64 <= F.element_at(share, F.col("_label"))
    place = F.row_number().over(Window.partitionBy("_label").orderBy("_order", "text"))
    found = short.where(near).withColumn("_place", place).where(F.col("_place") <= docs).orderBy("_label", "_place").select("text", "_label").toArrow()
    return found["text"].to_pylist(), found["_label"].to_pylist()
