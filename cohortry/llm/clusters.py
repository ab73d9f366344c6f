"""Clusters around centroids, the nearest found by a vantage-point tree.

In every round the centroids become a vantage-point tree, built on the driver and broadcast: their number
is a setting. A node has a vantage centroid; the others below it part by their distance from it, and
the least and largest distance on each side are kept. Each vector searches the tree best
first: of the nodes it has not seen it takes the one of the smallest possible distance, until that is larger than its best;
a bound that equals the best is still looked at, as a smaller number may be there. Distances that decide are exact integers.

Tasks add up the vectors of each cluster before anything is shuffled, so a cluster
that holds most rows costs one row per component and task. Sums are exact at any size of the components.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import local_frame, stored

_MOST = 2**63 - 1
_LIMB = 32


@dataclass(frozen=True)
class Settings:
    clusters: int = 40
    rounds: int = 5
    dim: int = 64
    scale: int = 256
    seed: int = 2
    leaf: int = 4  # centroids of a leaf
    cells: int = 1 << 20  # vectors times nodes that are searched at once


class Tree:
    """A vantage-point tree over integer vectors held as rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = Settings.leaf):
        self.points = points
        self.members: list[np.ndarray] = []  # of a node: its vantage point, or all of a leaf
        self.sides: list[list[tuple[int, float, float]]] = []  # (node, least, largest distance from the vantage point)
        todo: list[tuple[np.ndarray, tuple[int, int] | None]] = [(np.arange(len(points)), None)]
        while todo:
            rows, above = todo.pop()
            node = len(self.members)
            if above is not None:
                self.sides[above[0]][above[1]] = (node, *self.sides[above[0]][above[1]][1:])
            if len(rows) <= leaf:
                self.members.append(rows)
                self.sides.append([])
                continue
            far = squares(points[rows[:1]], points[rows])[0].astype(float)
            vantage = int(far.argmax())  # a point at the edge parts the others best
            rest = np.delete(rows, vantage)
            away = np.sqrt(squares(points[rows[[vantage]]], points[rest])[0].astype(float))
            order = np.argsort(away, kind="stable")
            self.members.append(rows[[vantage]])
            self.sides.append([])
            for side in (order[: len(order) // 2], order[len(order) // 2 :]):
                todo.append((rest[side], (node, len(self.sides[node]))))
                self.sides[node].append((-1, float(away[side].min()), float(away[side].max())))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the nearest point of each vector (ties: the smaller row), and the exact squared distance."""
        every = np.arange(len(vectors))
        number, square = np.full(len(vectors), -1), np.full(len(vectors), -1, vectors.dtype)
        reach = np.full(len(vectors), np.inf)
        bound = np.full((len(vectors), len(self.members)), np.inf)
        bound[:, 0] = 0
        while True:
            node = bound.argmin(axis=1)
            least = bound[every, node]
            active = np.flatnonzero(np.isfinite(least) & (least <= reach))
            if not len(active):
                return number, square
            by_node = active[np.argsort(node[active], kind="stable")]
            for group in np.split(by_node, np.flatnonzero(np.diff(node[by_node])) + 1):
                at = int(node[group[0]])
                bound[group, at] = np.inf
                far = squares(vectors[group], self.points[self.members[at]])
                for member, found in zip(self.members[at].tolist(), far.T, strict=True):
                    nearer = (number[group] < 0) | (found < square[group]) | ((found == square[group]) & (member < number[group]))
                    number[group[nearer]], square[group[nearer]] = member, found[nearer]
                reach[group] = np.sqrt(square[group].astype(float)) * (1 + 1e-9)
                if self.sides[at]:
                    away = np.sqrt(far[:, 0].astype(float))
                    for below, low, high in self.sides[at]:
                        bound[group, below] = np.maximum(least[group], np.maximum(away - high, low - away) - 1e-9 * (away + high))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, in 64 bits or, for arrays of Python's integers, in any number of bits."""
    out = np.zeros((len(a), len(b)), a.dtype if b.dtype == a.dtype else object)
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        out += gap * gap
    return out


def _narrow(dim: int) -> int:
    """Components up to this size have squared distances of fewer than 63 bits."""
    return int((2.0**62 / max(dim, 1)) ** 0.5 / 2)


def _whole(values: np.ndarray) -> np.ndarray:
    """Integers that doubles hold, as Python's integers."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _slices(column: pa.Array, dim: int, scale: int, centroids: np.ndarray, nodes: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) of a column, some at a time; those with very large components as Python's integers."""
    given = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) * scale)
    small = (np.abs(given) <= _narrow(dim)).all(axis=1) & (centroids.dtype != object)
    for wide, rows in ((False, np.flatnonzero(small)), (True, np.flatnonzero(~small))):
        step = max(1, cells // max(nodes, dim))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            yield some, _whole(given[some]) if wide else given[some].astype(np.int64)


def _matrix(centroids: list[list[int]], dim: int) -> np.ndarray:
    """Rows of integers, in 64 bits where distances to components of that size fit."""
    kind = np.int64 if all(abs(x) <= _narrow(dim) for row in centroids for x in row) else object
    return np.array(centroids, kind).reshape(-1, dim)


def kept(df: DataFrame, key: str, vector: str, settings: Settings) -> DataFrame:
    """(id, v) of the rows whose vector has ``dim`` components, none null or non-finite, as a written table."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * settings.scale) < float("inf")))
    return stored(df.select(F.col(f"`{key}`").alias("id"), x.alias("v")).where((F.size("v") == settings.dim) & good))


def first_centroids(vectors: DataFrame, settings: Settings) -> list[list[int]]:
    """The vectors of the smallest hashes of their keys, in that order; a null key counts as empty."""
    mark = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(mark, "id", "v").limit(settings.clusters).select("v").toArrow()["v"].to_pylist()
    return [[int(np.floor(x * settings.scale)) for x in row] for row in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], settings: Settings) -> list[list[int]]:
    """The centroids after one round: the mean of their vectors, rounded down by component; one without vectors stays."""
    s, points = settings, _matrix(centroids, settings.dim)
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(points, s.leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tree.value
        counts, sums = np.zeros(len(found.points), np.int64), np.zeros((len(found.points), s.dim), np.int64)
        large: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(s.dim, object))
        for batch in batches:
            for _, some in _slices(batch.column(0), s.dim, s.scale, found.points, len(found.members), s.cells):
                number, _ = found.nearest(some)
                counts += np.bincount(number, minlength=len(counts))
                for cluster in np.unique(number):
                    total = some[number == cluster].sum(axis=0)
                    if some.dtype == object:
                        large[int(cluster)] += total
                    else:
                        sums[cluster] += total
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(counts) if n]
        rows += [(int(c), int(i), 0, int(sums[c, i])) for c, i in zip(*np.nonzero(sums), strict=True)]
        for c, total in large.items():
            for i, value in enumerate(total):
                limb = 0
                while value:  # the last limb carries the sign
                    part = value if abs(value) < 1 << _LIMB else value & ((1 << _LIMB) - 1)
                    rows.append((c, i, limb, part))
                    value, limb = (value - part) >> _LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "amount"])

    partial = vectors.select("v").mapInArrow(run, "cluster int, place int, limb int, amount long")
    total = F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")
    # clusters times components rows, and their limbs
    facts = partial.groupBy("cluster", "place", "limb").agg(total).collect()
    tree.unpersist()
    sums: dict[tuple[int, int], int] = defaultdict(int)
    for row in facts:
        sums[row["cluster"], row["place"]] += int(row["amount"]) << _LIMB * row["limb"]
    return [[sums[c, i] // sums[c, -1] for i in range(s.dim)] if sums[c, -1] else old for c, old in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]], settings: Settings) -> DataFrame:
    """(id, cluster, distance) of every vector; a squared distance beyond a long is given as the largest long."""
    s = settings
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(_matrix(centroids, s.dim), s.leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tree.value
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, some in _slices(batch.column(1), s.dim, s.scale, found.points, len(found.members), s.cells):
                cluster[rows], square = found.nearest(some)
                distance[rows] = np.minimum(square, _MOST)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def fit(vectors: DataFrame, settings: Settings = Settings()) -> list[list[int]]:
    """The final centroids of ``kept`` vectors."""
    centroids = first_centroids(vectors, settings)
    for _ in range(settings.rounds if centroids else 0):
        centroids = moved(vectors, centroids, settings)
    return centroids


def _long(value: int) -> int:
    return min(value, _MOST)


def clustered(df: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row with a whole vector.

    Rows whose vector is null, of another length than ``dim``, or has null or non-finite components take no part. Repeated rows and
    null keys are vectors like any other. With fewer vectors than clusters each is a first centroid. Sums
    beyond a long are given as the largest long. Other columns play no part; an empty table gives an empty result.
    """
    spark: SparkSession = df.sparkSession
    vectors = kept(df, key, vector, settings)
    centroids = fit(vectors, settings)
    found = stored(assigned(vectors, centroids, settings)) if centroids else vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    inertia = {row["cluster"]: int(row["s"]) for row in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]
    numbers = sorted(inertia)
    facts = {"cluster": numbers, "cluster_inertia": [_long(inertia[c]) for c in numbers], "inertia": [_long(sum(inertia.values()))] * len(numbers), "centroid_sha256": [marks[c] for c in numbers]}
    kinds = {"cluster": pa.int32(), "cluster_inertia": pa.int64(), "inertia": pa.int64(), "centroid_sha256": pa.string()}
    joined = found.join(local_frame(spark, facts, kinds), "cluster")
    return joined.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
