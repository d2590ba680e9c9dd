"""Centroid clustering over whole-number vectors, nearest centroids found in a vantage-point tree.

Lloyd's rounds in exact integers. In each round the driver builds a vantage-point tree (Yianilos,
1993) over the centroids and broadcasts it. A task looks its vectors up in it by best-first branch
and bound: every vector keeps the lower bound of each subtree it hasn't entered, enters the one
with the smallest bound, computes the exact squared distance to that node's centroid, and stops
when no bound is at most its best distance. The radius is inclusive, so centroids at the same
distance are all met and the smaller number wins. Bounds are floating-point numbers less a slack,
distances are integers, so rounding can cost a visit but no tie and no nearest centroid. A block of
vectors takes these steps together.

Tasks send a count and component sums for each centroid; the driver gets one number per centroid
and component. Nothing else grows with the input but the scan.

Defined results: vectors that are NULL, of another length, or hold NULL or non-finite components
take no part. Fewer vectors than centroids give as many centroids. Rows with a NULL id are
clustered, but start a centroid only after all others; equal ids start in the order of their
components. Repeated rows count each. A centroid without vectors stays where it is. Whole numbers
beyond 63 bits are cut to that range, as are distances and inertias. Only the id and the vector are
read; other columns, whatever their names, aren't touched. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.tables import written

MOST = 2**63 - 1
_BLOCK = 8192  # vectors that walk the tree together


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    """TRUE for vectors without NULL and non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def safe_size(dim: int) -> int:
    """Components up to this size have squared distances within 63 bits."""
    return 1 << max(0, int((62 - math.log2(max(dim, 1))) // 2) - 1)


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without NULLs as a matrix; whole numbers of any size if 64 bits may not do."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    small = not flat.size or max(abs(int(flat.min())), abs(int(flat.max()))) <= safe_size(dim)
    return flat if small else flat.astype(object)


class VantageTree:
    """A vantage-point tree over the centroids, for blocks of vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.dim = len(centroids[0])
        small = max((abs(x) for c in centroids for x in c), default=0) <= safe_size(self.dim)
        self.points = np.array(centroids, np.int64 if small else object).reshape(len(centroids), self.dim)
        self.number: list[int] = []  # the centroid at each node
        self.children: list[list[tuple[int, float, float]]] = []  # (node, nearest, farthest)
        self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        node = len(self.number)
        spread = [sum(map(abs, self.centroids[m])) for m in members]
        point = members[spread.index(max(spread))]
        rest = [m for m in members if m != point]
        self.number.append(point)
        self.children.append([])
        if rest:
            far = self._distances(self.points[rest], point)
            order = sorted(range(len(rest)), key=lambda i: far[i])
            for half in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]):
                if half:
                    roots = [math.sqrt(far[i]) for i in half]
                    child = self._build([rest[i] for i in half])
                    self.children[node].append((child, min(roots), max(roots)))
        return node

    def _distances(self, rows: np.ndarray, number: int) -> np.ndarray:
        """Exact squared distances to one centroid."""
        point = self.points[number]
        apart = rows - point if rows.dtype == point.dtype else rows.astype(object) - point.astype(object)
        return (apart * apart).sum(axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid."""
        n = len(rows)
        best = np.full(n, -1, rows.dtype if rows.dtype == self.points.dtype else object)
        number = np.full(n, len(self.centroids), np.int64)
        root = np.full(n, np.inf)
        bound = np.full((n, len(self.number)), np.inf)
        bound[:, 0] = 0
        while n:
            node = bound.argmin(axis=1)
            low = bound[np.arange(n), node]
            open_ = np.flatnonzero((low <= root) & np.isfinite(low))  # inclusive: ties are met
            if not len(open_):
                break
            for at in np.unique(node[open_]):
                some = open_[node[open_] == at]
                far = self._distances(rows[some], self.number[at])
                here = self.number[at]
                better = (best[some] < 0) | (far < best[some])
                better |= (far == best[some]) & (here < number[some])
                took = some[better]
                best[took], number[took] = far[better], here
                away = np.sqrt(far.astype(np.float64))
                root[took] = away[better]
                bound[some, at] = np.inf
                for child, near, farthest in self.children[at]:
                    reach = np.maximum(near - away, away - farthest)
                    slack = 1e-9 * (1 + away + farthest)
                    bound[some, child] = np.maximum(low[some], reach - slack)
        return number, best


def _sums(tree):
    """Count and component sums of each centroid's vectors, once a task; position -1 is the count."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = tree.value
        total = [[0] * (walk.dim + 1) for _ in walk.centroids]
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                rows = rows_of(batch.column(0).slice(start, _BLOCK), walk.dim)
                number, _ = walk.nearest(rows)
                for c in np.unique(number):
                    mine = rows[number == c]
                    added = [len(mine), *mine.sum(axis=0).tolist()]
                    total[c] = [a + int(b) for a, b in zip(total[c], added)]
        found = [(c, p - 1, Decimal(x)) for c, row in enumerate(total) if row[0] for p, x in enumerate(row)]
        names = ("cluster", "position", "total")
        types = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return sums


def _assign(tree):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = tree.value
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                some = batch.slice(start, _BLOCK)
                number, far = walk.nearest(rows_of(some.column(1), walk.dim))
                if far.dtype == object:
                    far = np.array([min(x, MOST) for x in far], np.int64)
                columns = [some.column(0), pa.array(number.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return assign


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Components of the ``k`` vectors with the smallest hash of ``<seed>:<id>``."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(mark.asc_nulls_last(), "numbers").limit(k)
    return [list(row["numbers"]) for row in first.select("numbers").collect()]


def cluster_vectors(
    table: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    dim: int = 64,
    scale: int = 1024,
    clusters: int = 8,
    rounds: int = 10,
    seed: int = 3,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector that takes part."""
    spark = table.sparkSession
    value = F.col(vector)
    kept = written(
        table.where((F.size(value) == dim) & finite(value)).select(
            F.col(id).alias("id"), whole_numbers(value, scale).alias("numbers")
        ),
        "whole-vectors",
    )
    centroids = first_centroids(kept, clusters, seed)
    shape = f"id {dict(kept.dtypes)['id']}, cluster int, distance long"
    if not centroids:
        extra = "cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], f"{shape}, {extra}")
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        parts = kept.select("numbers").mapInArrow(
            _sums(tree), "cluster int, position int, total decimal(38,0)"
        )
        # One number per centroid and component reaches the driver.
        found = parts.groupBy("cluster", "position").agg(F.sum("total").alias("total")).collect()
        tree.unpersist()
        total = {(r["cluster"], r["position"]): int(r["total"]) for r in found}
        moved = [
            [total[c, p] // total[c, -1] for p in range(dim)] if (c, -1) in total else old
            for c, old in enumerate(centroids)
        ]
        if moved == centroids:  # further rounds change nothing
            break
        centroids = moved
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    assigned = written(kept.mapInArrow(_assign(tree), shape), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertias = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(exact.alias("s")).collect()}
    of = [
        (c, min(x, MOST), min(sum(inertias.values()), MOST), centroids[c]) for c, x in inertias.items()
    ]
    ends = spark.createDataFrame(
        of, "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    )
    return assigned.join(F.broadcast(ends), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def digest(centroid: list[int]) -> str:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
