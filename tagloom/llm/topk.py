"""Exact top-k by inner product through a pivot table.

Laesa (Micó, Oncina and Vidal, 1994) over inner products. Vectors are lifted onto a sphere: with M
the largest norm, ``v' = (v, sqrt(M² - |v|²))`` and ``q' = (M q / |q|, 0)`` all have norm M, and the
inner product falls with the distance of q' and v'. The distances of every vector to many pivots
are computed once and written: the pivot table. For a query, ``max over p of |d(q',p') - d(v',p')|``
is a lower bound of ``d(q',v')`` and so gives an upper bound of the score. Candidates are evaluated
in the order of their bounds and the search stops exactly where the next bound is below the k-th
best score found. Bounds are floating-point numbers with a slack for their rounding; scores are
exact integers.

Work is dealt by cell: each vector lies in the cell of its nearest pivot, and for each cell and
pivot the smallest and largest distance are kept (pivots squared numbers, on the driver). A query
starts with the k-th best score it reaches in a bounded sample of vectors, and visits the cells
whose bound reaches that. Cells are cut into blocks of vectors and of visiting queries; each pair of
blocks is a group of bounded size, so a crowded cell (a vector with very many copies) spreads over
many tasks. A group gives at most k rows a query.

Defined results: vectors that are NULL or hold NULL or non-finite components take no part. A
query's own row is every row with its id (NULL is an id of its own, and comes last among ties).
Queries meet candidates of their own length only. Rows repeated as a whole are candidates each and
queries each. Whole numbers beyond 63 bits are cut to that range, as are scores, before ranking. An
empty table gives no rows. Only the id and the vector are read; other columns aren't touched.

Pivots are chosen, farthest first, from ``SAMPLE`` vectors at most for each of the ``LENGTHS`` most
common lengths; vectors of other lengths have no bounds and are all evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.llm.clusters import MOST, finite, whole_numbers
from tagloom.llm.tables import written
from tagloom.session import small_side

PIVOTS, SAMPLE, LENGTHS = 32, 4096, 8
CANDIDATES, QUERIES = 4096, 1024
_CHUNK = 1 << 20  # bounds computed at once
_LAST = np.iinfo(np.int64).max  # stands for a NULL id in the order


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A list column of one length without NULLs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


class Scores:
    """Exact inner products with a set of vectors, cut to 64 bits."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.doubles = vectors, vectors.astype(np.float64)
        self.most = float(np.abs(self.doubles).max(initial=0))

    def _in_doubles(self, queries: np.ndarray) -> bool:
        """Every partial sum is a whole number that a double holds."""
        most = float(np.abs(queries.astype(np.float64)).max(initial=0))
        return most * self.most * self.vectors.shape[1] < 2**53

    def of(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self._in_doubles(query):
            return (self.doubles[places] @ query.astype(np.float64)).astype(np.int64)
        exact = (self.vectors[places].astype(object) * query.astype(object)).sum(axis=1)
        return np.array([max(-MOST - 1, min(int(x), MOST)) for x in exact], np.int64)

    def all(self, queries: np.ndarray) -> np.ndarray:
        if self._in_doubles(queries):
            return (queries.astype(np.float64) @ self.doubles.T).astype(np.int64)
        return np.stack([self.of(np.arange(len(self.vectors)), q) for q in queries])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    return np.lexsort((ids, ~scores))[:k]


@dataclass
class PivotTable:
    """Pivots for vectors of one length and the sample that gives queries their first threshold."""

    pivots: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    norm: float  # the largest of any vector of this length

    def __post_init__(self):
        self.norm = max(self.norm, 1.0)
        # Squared distances are off by a few units in the last place of the squared norm.
        self.slack = 8 * self.norm * math.sqrt((self.pivots.shape[1] + 4) * 2.3e-16)
        points = self.pivots.astype(np.float64)
        self._points = np.hstack([points, self._lift(points)[:, None]])

    def _lift(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - (rows**2).sum(axis=1), 0))

    def _to(self, lifted: np.ndarray) -> np.ndarray:
        squares = 2 * self.norm**2 - 2 * lifted @ self._points.T  # all norms are the same
        return np.sqrt(np.maximum(squares, 0))

    def of_candidates(self, rows: np.ndarray) -> np.ndarray:
        """Distance of each vector to each pivot."""
        rows = rows.astype(np.float64)
        return self._to(np.hstack([rows, self._lift(rows)[:, None]]))

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = rows * (self.norm / np.where(norms > 0, norms, 1))
        rest = np.sqrt(np.maximum(self.norm**2 - (rows**2).sum(axis=1), 0))  # a zero query: the pole
        return self._to(np.hstack([rows, rest[:, None]]))

    def highest(self, query_norms: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Upper bounds of scores where distances are at least ``low``."""
        low = np.maximum(low - self.slack, 0)
        cosine = 1 - low**2 / (2 * self.norm**2)
        # What rounding may take from the bound is far below this margin.
        return query_norms * self.norm * (cosine + 1e-9)

    def thresholds(self, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query in the sample; the least number if there are too few."""
        if len(self.sample) < k:
            return np.full(len(rows), -MOST - 1, np.int64)
        scores = Scores(self.sample).all(rows)
        scores[ids[:, None] == self.sample_ids[None]] = -MOST - 1
        return np.partition(scores, len(self.sample) - k, axis=1)[:, len(self.sample) - k]


def farthest_first(rows: np.ndarray, norm: float, most: int) -> np.ndarray:
    """Up to ``most`` rows, each as far as possible from those before it."""
    norm = max(norm, 1.0)
    points = rows.astype(np.float64)
    points = np.hstack([points, np.sqrt(np.maximum(norm**2 - (points**2).sum(axis=1), 0))[:, None]])
    chosen, apart = [0], np.full(len(points), np.inf)
    while len(chosen) < min(most, len(points)):
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if apart.max() <= 1e-9 * norm**2:  # only copies are left
            break
        chosen.append(int(apart.argmax()))
    return rows[chosen]


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by vector length; the vector is the column ``numbers``."""
    dims = batch.column("numbers").value_lengths().to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _doubles(rows: np.ndarray) -> pa.Array:
    steps = np.arange(0, rows.size + 1, max(rows.shape[1], 1)) if rows.shape[1] else np.zeros(len(rows) + 1)
    return pa.ListArray.from_arrays(pa.array(steps.astype(np.int32)), pa.array(rows.ravel()))


def _table_of(tables):
    """Adds each vector's cell and its distances to the pivots."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _lengths(batch):
                table = tables.value.get(dim)
                far = np.zeros((some.num_rows, 0))
                if table is not None:
                    far = table.of_candidates(_matrix(some.column("numbers")))
                cell = far.argmin(axis=1) if far.shape[1] else np.zeros(some.num_rows, np.int64)
                dims = np.full(some.num_rows, dim, np.int32)
                columns = [pa.array(dims), pa.array(cell.astype(np.int32)), *some.columns, _doubles(far)]
                names = ["dim", "cell", *some.schema.names, "far"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return add


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest and largest distance by cell and pivot, and the cell's rows at pivot -1."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
        for dim, cell in np.unique(keys, axis=0).tolist():
            some = batch.column(2).filter(pa.array((keys == [dim, cell]).all(axis=1)))
            far = _matrix(some, np.float64)
            ends = [far.min(axis=0), far.max(axis=0)]
            n, low, high = found.get((dim, cell), [0, *ends])
            found[dim, cell] = [n + len(some), np.minimum(low, ends[0]), np.maximum(high, ends[1])]
    rows = [
        (dim, cell, p, n, lo, hi)
        for (dim, cell), (n, low, high) in found.items()
        for p, lo, hi in [(-1, 0.0, 0.0), *zip(range(len(low)), low.tolist(), high.tolist())]
    ]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
    names = ("dim", "cell", "pivot", "n", "low", "high")
    columns = zip(*rows) if rows else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _visits(tables, cells, k: int):
    """A row for every cell that a query has to visit, with the score it has to reach there."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, whole in _lengths(batch):
                for start in range(0, whole.num_rows, QUERIES):
                    some = whole.slice(start, QUERIES)
                    rows, ids = _matrix(some.column("numbers")), _ids(some.column("id"))
                    table = tables.value.get(dim)
                    numbers = np.array(sorted(c for d, c in cells.value if d == dim), np.int32)
                    far = np.zeros((len(rows), 0))
                    least = np.full(len(rows), -MOST - 1, np.int64)
                    enter = np.ones((len(rows), len(numbers)), bool)
                    if table is not None:
                        far, least = table.of_queries(rows), table.thresholds(rows, ids, k)
                        norms = np.linalg.norm(rows.astype(np.float64), axis=1)
                        for j, c in enumerate(numbers):
                            low, high = cells.value[dim, int(c)]
                            apart = np.maximum(low - far, far - high).max(axis=1, initial=0)
                            enter[:, j] = table.highest(norms, apart) >= least
                    at, j = np.nonzero(enter)
                    taken = some.take(pa.array(at))
                    columns = [
                        pa.array(np.full(len(at), dim, np.int32)),
                        pa.array(numbers[j]),
                        *taken.columns,
                        _doubles(far[at]),
                        pa.array(least[at]),
                    ]
                    names = ["dim", "cell", *taken.schema.names, "far", "least"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return visit


def _evaluate(tables, k: int):
    """The best candidates of a block for each query of a block."""

    def evaluate(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            queries, candidates = queries.combine_chunks(), candidates.combine_chunks()
            column = lambda t, name: t.column(name).chunk(0)
            table = tables.value.get(int(queries.column("dim")[0].as_py()))
            q, c = _matrix(column(queries, "numbers")), _matrix(column(candidates, "numbers"))
            q_far = _matrix(column(queries, "far"), np.float64)
            c_far = np.ascontiguousarray(_matrix(column(candidates, "far"), np.float64).T)
            q_id, c_id = _ids(column(queries, "id")), _ids(column(candidates, "id"))
            least = column(queries, "least").to_numpy()
            norms = np.linalg.norm(q.astype(np.float64), axis=1)
            scores_of = Scores(c)
            step = max(1, _CHUNK // len(c))
            for start in range(0, len(q), step):
                some = slice(start, start + step)
                if table is None:
                    high = np.full((len(q[some]), len(c)), np.inf)
                else:
                    low = np.zeros((len(q[some]), len(c)))
                    for p in range(len(c_far)):
                        np.maximum(low, np.abs(q_far[some, p, None] - c_far[p]), out=low)
                    high = table.highest(norms[some, None], low)
                for i, bounds in enumerate(high, start):
                    places, scores = _search(q[i], scores_of, c_id, q_id[i], bounds, int(least[i]), k)
                    out["query"] += [queries.column("row")[i].as_py()] * len(places)
                    out["query_id"] += [queries.column("id")[i].as_py()] * len(places)
                    out["id"] += [candidates.column("id")[int(p)].as_py() for p in places]
                    out["score"] += scores.tolist()
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return evaluate


def _search(query, scores_of, ids, own, bounds, least, k):
    """Evaluate in bound order; stop where the next bound is below the k-th best score."""
    order = np.flatnonzero((bounds >= least) & (ids != own))
    order = order[np.argsort(-bounds[order], kind="stable")]
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 4 * k
    while at < len(order) and (len(places) < k or bounds[order[at]] >= scores[-1]):
        some = order[at : at + step]
        at, step = at + step, 2 * step
        places = np.concatenate([places, some])
        scores = np.concatenate([scores, scores_of.of(some, query)])
        best = _best(scores, ids[places], k)
        places, scores = places[best], scores[best]
    return places, scores


def _dealt(table: DataFrame, mine: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows dealt into the blocks of their cell, a copy for every block of the other side."""
    salt = F.pmod(F.xxhash64("row"), F.col(mine)).cast("int")
    copies = F.sequence(F.lit(0), F.col(other) - 1)
    joined = table.join(sizes, ["dim", "cell"])
    return joined.select(*table.columns, salt.alias(mine), F.explode(copies).alias(other))


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    scale: int = 256,
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    block: tuple[int, int] = (CANDIDATES, QUERIES),
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` candidates of the highest inner product by query.

    ``id`` is a whole number. The vectors' components are ``floor(scale * x)``.
    """
    spark = candidates.sparkSession

    def usable(table: DataFrame, name: str) -> DataFrame:
        value: Column = F.col(vector)
        kept = table.where(finite(value)).select(
            F.col(id).cast("long").alias("id"), whole_numbers(value, scale).alias("numbers")
        )
        return written(kept.withColumn("row", F.monotonically_increasing_id()), name)

    rows, asked = usable(candidates, "candidates"), usable(queries, "queries")
    square = F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = rows.groupBy(F.size("numbers").alias("dim")).agg(
        F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")
    )
    tables = {}
    for r in lengths.where("dim > 0").orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        mine = rows.where(F.size("numbers") == r["dim"]).orderBy(F.xxhash64("row"), "row").limit(sample)
        got = mine.select("id", "numbers").toArrow().combine_chunks()
        vectors = _matrix(got.column("numbers").chunk(0))
        tables[r["dim"]] = PivotTable(
            farthest_first(vectors, r["norm"], pivots), vectors, _ids(got.column("id").chunk(0)), r["norm"]
        )
    shared = spark.sparkContext.broadcast(tables)
    shape = "dim int, cell int, id long, numbers array<long>, row long, far array<double>"
    indexed = written(rows.mapInArrow(_table_of(shared), shape), "pivot-table")
    ranges = (
        indexed.select("dim", "cell", "far")
        .mapInArrow(_ranges, "dim int, cell int, pivot int, n long, low double, high double")
        .groupBy("dim", "cell", "pivot")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    ranges = written(ranges, "cells")
    inside: dict[tuple[int, int], dict] = {}
    # Pivots squared rows for each length that has pivots.
    for r in ranges.where(F.col("dim").isin([-1, *tables])).collect():
        inside.setdefault((r["dim"], r["cell"]), {})[r["pivot"]] = (r["low"], r["high"])
    cells = {
        key: tuple(np.array([of[p][end] for p in range(len(of) - 1)]) for end in (0, 1))
        for key, of in inside.items()
    }
    known = spark.sparkContext.broadcast(cells)
    without = asked.where(~F.size("numbers").isin([-1, *tables])).select(
        F.size("numbers").alias("dim"),
        F.lit(0).alias("cell"),
        *asked.columns,
        F.array().cast("array<double>").alias("far"),
        F.lit(-MOST - 1).cast("long").alias("least"),
    )
    visits = asked.where(F.size("numbers").isin([-1, *tables])).mapInArrow(
        _visits(shared, known, k), f"{shape}, least long"
    )
    visits = written(visits.unionByName(without), "visits")
    count = lambda n, most: F.ceil(F.sum(n) / F.lit(most)).cast("int")
    c_blocks = ranges.where("pivot = -1").groupBy("dim", "cell").agg(count("n", block[0]).alias("c_block"))
    q_blocks = visits.groupBy("dim", "cell").agg(count(F.lit(1), block[1]).alias("q_block"))
    sizes = small_side(written(c_blocks.join(q_blocks, ["dim", "cell"]), "block-counts"))
    key = ["dim", "cell", "c_block", "q_block"]
    found = (
        _dealt(visits, "q_block", "c_block", sizes)
        .groupBy(*key)
        .cogroup(_dealt(indexed, "c_block", "q_block", sizes).groupBy(*key))
        .applyInArrow(_evaluate(shared, k), "query long, query_id long, id long, score long")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _dealt(table: DataFrame, mine: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows dealt into the blocks of their cell, a copy for every block of the other side."""
    salt = F.pmod(F.xxhash64("row"), F.col(mine)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    joined = table.join(sizes, ["dim", "cell"])
    return joined.select(*table.columns, salt.alias(mine), F.col(other).alias("of")).select(
        *table.columns, mine, F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias(other)
    )
