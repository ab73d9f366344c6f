"""Exact top-k by inner product with an M-tree and best-first search.

Integer vectors get one more coordinate that makes all of them equally long; then the
largest inner product is the smallest Euclidean distance, a metric. The tree has
routing objects on top, a bounded number of them; below each stand blocks of a
bounded number of vectors; below a block its pages. Every page has a routing object, a
covering radius, its distance to the routing object above and its vectors'
distances to its own. The pages are one written table.

A query first visits the blocks of its nearest routing object, which gives it a k-th
best score; then only blocks whose bound can reach that score. Within a block it
visits pages in the order of their bounds until a bound falls below its k-th best. The triangle
inequality with the stored distances rules out pages and vectors whose distance then need not be computed.
Bounds allow for rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import stored

_MOST = 2**63 - 1
#: Longs of 60 bits that hold any product of vectors of finite components.
_LIMBS = 6
_RESULT = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Settings:
    k: int = 20
    routers: int = 2048  # at most; there is one per ``block`` vectors until then
    block: int = 4096
    page: int = 64
    chunk: int = 4096  # queries that a block is searched for at once


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double that holds the integer; null for a vector that is null, empty, or has a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond that a double is whole

    return F.when((F.size(vector) > 0) & good, F.transform(vector, whole))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that brings their squared length to ``most``."""
    return np.concatenate([vectors, np.sqrt(np.maximum(most - (vectors * vectors).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def _split(points: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Pages of at most ``most`` rows: two far objects are promoted, the others join the nearer, again and again."""
    done, todo = [], [rows]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        first = part[_distances(points[part[:1]], points[part])[0].argmax()]
        second = part[_distances(points[[first]], points[part])[0].argmax()]
        gap = _distances(points[[first]], points[part])[0] - _distances(points[[second]], points[part])[0]
        order = np.argsort(gap, kind="stable")
        cut = int(np.clip(np.searchsorted(gap[order], 0), len(part) // 4, len(part) - len(part) // 4))  # a page is never nearly empty, equal vectors part evenly
        todo += [part[order[:cut]], part[order[cut:]]]
    return done


def build(objects: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, dict]:
    """The written pages of an M-tree over (id, v) and what searches need of its top."""
    s = settings
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    facts = objects.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("v")).alias("dim")).first()
    n, dim, most = facts["n"], facts["dim"] or 1, float(facts["most"] or 0)
    wanted = int(min(s.routers, max(1, -(-n // s.block))))
    top = objects.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow()
    routers = _lifted(_matrix(top["v"], dim), most) if n else np.zeros((0, dim + 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_lifted(_matrix(batch.column(1), dim), most), routers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1), pa.int32())], names=["id", "v", "cell"])

    placed = stored(objects.select("id", "v").mapInArrow(assign, "id long, v array<double>, cell int"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    placed = placed.join(stored(cells), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pages(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["v"], dim)
        points, ids = _lifted(vectors, most), table["id"].to_numpy()
        cell = table["cell"][0].as_py()
        rows = []
        for part in _split(points, np.argsort(ids, kind="stable"), s.page):
            middle = points[part].mean(axis=0)
            router = part[((points[part] - middle) ** 2).sum(axis=1).argmin()]
            away = _distances(points[[router]], points[part])[0]
            above = float(_distances(points[[router]], routers[[cell]])[0, 0])
            rows.append((cell, table["block"][0].as_py(), vectors[router], float(away.max()), above, ids[part], vectors[part].ravel(), away))
        names = ["cell", "block", "router", "radius", "above", "ids", "vectors", "away"]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "cell int, block int, router array<double>, radius double, above double, ids array<long>, vectors array<double>, away array<double>"
    made = stored(placed.select("cell", "block", "id", "v").groupBy("cell", "block").applyInArrow(pages, schema))
    reach = made.groupBy("cell").agg(F.max(F.col("above") + F.col("radius")).alias("r")).toArrow()  # one row per routing object
    radius = np.full(len(routers), -np.inf)
    radius[reach["cell"].to_numpy()] = reach["r"].to_numpy()
    return made, {"routers": routers, "radius": radius, "most": most, "dim": dim}


def _best_first(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, table: pa.Table, top: dict, cell: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector id, score) of the candidates of one block that can be among each query's k best."""
    dim, most = top["dim"], top["most"]
    routers = _lifted(_matrix(table["router"], dim), most)
    radius, above = table["radius"].to_numpy(), table["above"].to_numpy()
    norm = (queries * queries).sum(axis=1)
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)

    def ceiling(nearest: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The largest score at a distance of at least ``nearest``."""
        return (norm[rows, None] + most - np.maximum(nearest, 0) ** 2) / 2 * (1 + 1e-9) + 1e-3

    to_cell = _distances(lifted, top["routers"][[cell]])[:, 0]
    every = np.arange(len(queries))
    # by stored distances alone; only pages that this leaves open to some query have their distance computed
    bound = ceiling(np.abs(to_cell[:, None] - above) - radius, every)
    open_pages = np.flatnonzero((bound >= floor[:, None]).any(axis=0))
    to_page = np.full(bound.shape, np.nan)
    to_page[:, open_pages] = _distances(lifted, routers[open_pages])
    bound[:, open_pages] = np.minimum(bound[:, open_pages], ceiling(to_page[:, open_pages] - radius[open_pages], every))
    order = np.argsort(-bound, axis=1, kind="stable")
    best_score = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    contents = {}
    for turn in range(order.shape[1]):
        page = order[:, turn]
        least = np.maximum(floor, best_score[:, -1])
        active = np.flatnonzero(bound[every, page] >= least)
        if not len(active):
            break
        by_page = active[np.argsort(page[active], kind="stable")]
        for group in np.split(by_page, np.flatnonzero(np.diff(page[by_page])) + 1):
            at = int(page[group[0]])
            if at not in contents:
                contents[at] = (table["ids"][at].values.to_numpy(), table["vectors"][at].values.to_numpy().reshape(-1, dim), table["away"][at].values.to_numpy())
            ids, vectors, away = contents[at]
            possible = ceiling(np.abs(to_page[group, at][:, None] - away), group) >= least[group, None]
            some = possible.any(axis=0)
            if not some.any():
                continue
            score = np.where(possible[:, some], np.rint(queries[group] @ vectors[some].T), -np.inf)
            who = np.broadcast_to(ids[some], score.shape)
            score = np.where(who == own[group, None], -np.inf, score)
            both_score = np.concatenate([best_score[group], score], axis=1)
            both_id = np.concatenate([best_id[group], who], axis=1)
            rank = np.lexsort((both_id, -both_score), axis=1)[:, :k]
            best_score[group] = np.take_along_axis(both_score, rank, axis=1)
            best_id[group] = np.take_along_axis(both_id, rank, axis=1)
    query, place = np.nonzero(np.isfinite(best_score) & (best_score >= floor[:, None]))
    return query, best_id[query, place], best_score[query, place].astype(np.int64)


def _visit(pairs: DataFrame, pages: DataFrame, top: dict, s: Settings) -> DataFrame:
    """Candidates of (query, cell) pairs; a block and a bounded number of queries meet at a time."""
    blocks = stored(pages.select("cell", "block").distinct())
    # pages are copied as often as their own cell's queries ask for; pages of cells without queries not at all
    parts = stored(pairs.groupBy("cell").agg(F.ceil(F.count("*") / s.chunk).cast("int").alias("parts")))
    asked = pairs.join(blocks, "cell").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    held = pages.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            ids = left["id"].to_numpy()
            queries = _matrix(left["v"], top["dim"])
            query, vec, score = _best_first(queries, ids, left["floor"].to_numpy(), right, top, right["cell"][0].as_py(), s.k)
            out = [ids[query], vec, score]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    keys = ["cell", "block", "part"]
    return asked.select(*keys, "id", "v", "floor").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, _RESULT)


def _cells(queries: DataFrame, top: dict, nearest: bool) -> DataFrame:
    """(id, v, floor, cell): the nearest routing object of each query, or all others whose ball can hold a score of at least the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                vectors = _matrix(part.column(1), top["dim"])
                far = _distances(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1), top["routers"])
                near = far.argmin(axis=1)
                chosen = np.zeros(far.shape, bool)
                chosen[np.arange(len(far)), near] = True
                if not nearest:
                    bound = ((vectors * vectors).sum(axis=1)[:, None] + top["most"] - np.maximum(far - top["radius"], 0) ** 2) / 2 * (1 + 1e-9) + 1e-3
                    chosen = ~chosen & (bound >= part.column(2).to_numpy()[:, None]) & np.isfinite(top["radius"])
                row, cell = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in part.columns], pa.array(cell, pa.int32())], names=["id", "v", "floor", "cell"])

    return queries.select("id", "v", "floor").mapInArrow(run, "id long, v array<double>, floor double, cell int")


def _limbs(value: int) -> list[int]:
    """An integer of any size as longs that compare as it does."""
    return [value >> 60 * i & (1 << 60) - 1 if i < _LIMBS - 1 else value >> 60 * i for i in reversed(range(_LIMBS))]


def _exact(rows: DataFrame, n: int, n_large: int, s: Settings) -> DataFrame:
    """(query_id, vec_id, score, limbs): the k best of pairs with a vector of very large components, in exact integers.

    Such vectors meet all rows in blocks of bounded size. A score beyond a long is given as the nearest long.
    """
    large = rows.where("large").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(-(-n_large // s.page))).cast("int"))
    parts = max(1, -(-n // s.block))
    large = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n_large // s.page) - 1))))

    def whole(table: pa.Table) -> np.ndarray:
        return np.array([[int(x) for x in row] for row in table["v"].to_pylist()], object)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            scores = whole(left) @ whole(right).T
            a, b = left["id"].to_pylist(), right["id"].to_pylist()
            asks, others = left["asks"].to_pylist(), [ask and not big for ask, big in zip(right["asks"].to_pylist(), right["large"].to_pylist(), strict=True)]
            for queries, ids, asked, table in ((a, b, asks, scores), (b, a, others, scores.T)):
                for query, ask, row in zip(queries, asked, table, strict=True):
                    if ask:
                        best = heapq.nsmallest(s.k, ((-score, vec) for score, vec in zip(row, ids, strict=True) if vec != query))
                        found += [(query, vec, max(-_MOST - 1, min(_MOST, -score)), _limbs(-score)) for score, vec in best]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
        return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "limbs"])

    names = ["block", "part", "id", "v", "asks", "large"]
    return large.select(*names).groupBy("block", "part").cogroup(every.select(*names).groupBy("block", "part")).applyInArrow(search, f"{_RESULT}, limbs array<long>")


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 64, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product of each query row, ties to the smaller key.

    Vectors that are null or hold null or non-finite components take no part, nor do
    rows without key and vectors of another length than the most frequent one. A query is not compared with rows of its own key; a
    repeated row counts once. Keys are integers. Components may be of any finite size: pairs with a vector whose products doubles
    cannot add exactly are compared in blocks, in integers of any size. Other columns play no part; an empty table gives an empty result.
    """
    s = settings
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows.where("id is not null and v is not null").dropDuplicates(["id", "v"]))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    biggest = F.array_max(F.transform("v", F.abs))
    rows = rows.where(F.size("v") == (length["d"] if length else 1)).withColumn("large", biggest * biggest * F.size("v") > 2.0**53)
    n, n_large = rows.agg(F.count("*"), F.count_if("large")).first()
    plain = rows.where("not large")
    pages, top = build(plain.select("id", "v"), s)
    queries = plain.where("asks").select("id", "v", F.lit(float("-inf")).alias("floor"))
    first = stored(_visit(stored(_cells(queries, top, True)), pages, top, s))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = first.withColumn("place", place).where(F.col("place") == s.k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("known"))
    queries = queries.join(stored(floors), "id", "left").select("id", "v", F.coalesce("known", "floor").alias("floor"))
    second = stored(_visit(stored(_cells(queries, top, False)), pages, top, s))
    found = first.unionByName(second).distinct()
    if n_large:
        sign = F.when(F.col("score") < 0, -1).otherwise(0).cast("long")
        found = found.withColumn("limbs", F.array(*[sign] * (_LIMBS - 2), F.shiftright("score", 60), F.col("score").bitwiseAND(F.lit((1 << 60) - 1))))
        found = found.unionByName(_exact(rows, n, n_large, s)).distinct()
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("limbs"), "vec_id"))
    found = found.withColumn("rank", place).where(F.col("rank") <= s.k)
    return found.select("query_id", "rank", "vec_id", "score")
