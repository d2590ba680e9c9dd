"""Near-duplicate vectors through an inverted multi-index.

Babenko and Lempitsky, "The Inverted Multi-Index" (CVPR 2012): the two halves of a vector have
codebooks of their own, whose product is a grid of cells. A vector lies in the cell of its nearest
codewords. As a query it visits cells in the order of the summed distances of its halves (the
multi-sequence order) until the target recall is reached; the vectors of visited cells are compared
by their exact cosine.

Where the traversal stops is measured, not guessed: for vectors of the sample, partners are made at
exactly the threshold cosine, in random directions, and the stop is set so that the target share of
these hardest pairs meets: one of the two visits the other's cell. Closer pairs meet more often.
Every vector is indexed and every vector is a query; no list of a cell is cut.

Equal vectors are one class. A cell's members and its visitors are dealt into blocks; each pair of
blocks is one task's matrix product, so a crowded cell is spread over many tasks and a task holds
two blocks. A task gives link counts and a spanning forest of its links, never the pairs.

Defined results: vectors that are NULL, empty, all zero, or hold NULL or non-finite components link
with nothing. Vectors of different lengths don't link. Rows repeated as a whole link with each
other. A NULL id is no candidate for the smallest id of a component; without any other it stays
NULL. Further columns never enter the job. The codebooks are fitted on ``SAMPLE_PER_WORD`` vectors
a codeword, ``MOST_WORDS`` codewords a half at most, which bounds the sample by 32,768 vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tagloom.llm.tables import written
from tagloom.operators.components import connected_components
from tagloom.session import small_side

ROWS_PER_CELL, MOST_WORDS, SAMPLE_PER_WORD = 256, 512, 64
MEMBERS, VISITORS = 4096, 16384
TARGET_RECALL = 0.99
_CHUNK = 1 << 20  # cosines computed at once


def _unit(packed: list[bytes], dtype: str) -> np.ndarray:
    """Packed vectors of one length as unit rows in double precision."""
    rows = np.frombuffer(b"".join(packed), dtype).reshape(len(packed), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _pack(dtype: str):
    """``(id, digest, vector)``: the raw components as bytes; NULL if they can't be compared."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for value in batch.column(1):
                found = value.values if value.is_valid else None
                usable = found is not None and len(found) and not found.null_count
                row = np.asarray(found.to_numpy(zero_copy_only=False), dtype) if usable else None
                if row is None or not np.isfinite(row).all() or not row.any():
                    digests.append(None)
                    vectors.append(None)
                else:
                    vectors.append(row.tobytes())
                    digests.append(xxhash.xxh3_128_digest(vectors[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                names=["id", "digest", "vector"],
            )

    return pack


def _kmeans(points: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Codewords of one half; starts from evenly spaced points, empty ones stay where they are."""
    centres = points[np.linspace(0, len(points) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=words)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (
        (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None, :]
    )


class Codebooks:
    """Two codebooks for vectors of one length, and the slack of their traversal."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        # One half of the sample gives the codewords, the other one tells where to stop.
        fitted, sample = sample[::2], sample[1::2] if len(sample) > 1 else sample
        self.words = max(1, min(words, len(fitted)))
        self.books = [_kmeans(part, self.words) for part in self._halves(fitted)]
        rnd = np.random.default_rng(11)
        noise = rnd.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        norms = np.linalg.norm(noise, axis=1, keepdims=True)
        noise /= np.where(norms > 0, norms, 1)
        partner = cosine * sample + math.sqrt(max(0.0, 1 - cosine**2)) * noise
        here, there = self.distances(sample), self.distances(partner)
        meets = np.minimum(self._excess(here, self.cells(there)), self._excess(there, self.cells(here)))
        # A target of 1 can't be told from a sample: every cell is visited.
        self.slack = float(np.quantile(meets, recall)) if recall < 1 else math.inf

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.half], rows[:, self.half :]

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self._halves(rows)
        return _distances(first, self.books[0]), _distances(second, self.books[1])

    def cells(self, distances: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return distances[0].argmin(axis=1) * self.words + distances[1].argmin(axis=1)

    def _excess(self, distances: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell each row's given cell is."""
        at = np.arange(len(cells))
        one, two = distances
        return (
            one[at, cells // self.words] + two[at, cells % self.words] - one.min(axis=1) - two.min(axis=1)
        )

    def visits(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return self._excess(self.distances(rows), cells) <= self.slack

    def traverse(self, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The visited cells of one vector in multi-sequence order, up to the slack.

        Both lists are sorted; for each entry of the first the second is followed while the sum
        stays within reach: the staircase that the multi-sequence algorithm walks.
        """
        one, two = (np.argsort(d, kind="stable") for d in row)
        near, far = row[0][one], row[1][two]
        reach = near[0] + far[0] + self.slack
        steps = np.searchsorted(far, reach - near, side="right")
        steps[0] = max(steps[0], 1)
        first = np.repeat(np.arange(self.words), steps)
        second = np.arange(len(first)) - np.repeat(np.cumsum(steps) - steps, steps)
        order = np.argsort(near[first] + far[second], kind="stable")
        return one[first[order]] * self.words + two[second[order]]


def _index(books: dict[int, Codebooks], dtype: str):
    """A row for every cell that a vector visits; its own cell comes as ``home``, too."""
    size = np.dtype(dtype).itemsize

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            homes, visited = np.zeros(len(packed), np.int64), [np.zeros(1, np.int64)] * len(packed)
            dims = np.array([len(p) // size for p in packed], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                book = books.get(int(dim))
                if book is None:
                    continue
                far = book.distances(_unit([packed[i] for i in at], dtype))
                homes[at] = book.cells(far)
                for k, i in enumerate(at):
                    visited[i] = book.traverse((far[0][k], far[1][k]))
            counts = np.array([len(v) for v in visited], np.int64)
            for some in _slices(counts):
                rows = np.repeat(np.arange(some.start, some.stop), counts[some])
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(dims[rows]),
                    pa.array(homes[rows]),
                    pa.array(np.concatenate(visited[some])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "dim", "home", "cell"])

    return index


def _slices(counts: np.ndarray, most: int = 50_000) -> Iterator[slice]:
    """Runs of rows that make about ``most`` rows each."""
    start = 0
    groups = np.cumsum(counts) // most if len(counts) else counts
    for stop in [*(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(counts)]:
        if stop > start:
            yield slice(start, stop)
            start = stop


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(books: dict[int, Codebooks], dtype: str, cosine: float):
    """Links between a block of members and a block of visitors of one cell."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(group["dim"].iloc[0]), int(group["cell"].iloc[0])
        member = group[group["member"]]
        visitor = group[~group["member"]]
        out = [pd.DataFrame({"digest": [], "links": np.empty(0, np.int64), "root": []})]
        if len(member) and len(visitor):
            book = books.get(dim)
            a, b = _unit(list(visitor["vector"]), dtype), _unit(list(member["vector"]), dtype)
            a_id, b_id = visitor["digest"].to_numpy(), member["digest"].to_numpy()
            a_n, b_n = visitor["copies"].to_numpy(), member["copies"].to_numpy()
            home = visitor["home"].to_numpy()
            step = max(1, _CHUNK // len(b))
            for at in range(0, len(a), step):
                i, j = np.nonzero(a[at : at + step] @ b.T >= cosine)
                i += at
                apart = a_id[i] != b_id[j]
                i, j = i[apart], j[apart]
                away = home[i] != cell
                if book is not None and away.any():
                    # If the member visits the visitor's cell as well, one of the two cells counts.
                    again = np.zeros(len(i), bool)
                    again[away] = book.visits(b[j[away]], home[i[away]]) & (cell > home[i[away]])
                    i, j, away = i[~again], j[~again], away[~again]
                if not len(i):
                    continue
                rows, columns = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                roots = _roots(rows[1], len(rows[0]) + columns[1], len(rows[0]) + len(columns[0]))
                names = np.concatenate([a_id[rows[0]], b_id[columns[0]]])
                links = np.concatenate(
                    [
                        np.bincount(rows[1], b_n[j], len(rows[0])),
                        np.bincount(columns[1], np.where(away, a_n[i], 0), len(columns[0])),
                    ]
                ).astype(np.int64)
                out.append(pd.DataFrame({"digest": names, "links": links, "root": names[roots]}))
        return pd.concat(out)[["digest", "links", "root"]]

    return compare


def near_vectors(
    table: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.9,
    recall: float = TARGET_RECALL,
    members: int = MEMBERS,
    visitors: int = VISITORS,
) -> DataFrame:
    """``(id, n_links, component_id)`` per row of ``table``."""
    element = table.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    values = F.col(vector) if dtype == "<f4" else F.col(vector).cast("array<double>")
    packed = written(
        table.select(F.col(id).cast("long").alias("id"), values.alias("v")).mapInArrow(
            _pack(dtype), "id long, digest binary, vector binary"
        ),
        "packed",
    )
    classes = written(
        packed.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "classes",
    )
    n = classes.count()
    books = _fit(classes, n, dtype, cosine, recall)

    visits = written(
        classes.select("digest", "vector").mapInArrow(
            _index(books, dtype), "digest binary, dim long, home long, cell long"
        ),
        "visits",
    )
    sizes = visits.groupBy("dim", "cell").agg(
        F.ceil(F.greatest(F.lit(1), F.count_if(F.col("cell") == F.col("home"))) / members).alias("m"),
        F.ceil(F.count("*") / visitors).alias("v"),
    )
    sizes = small_side(written(sizes, "sizes"))
    spot = lambda parts: F.pmod(F.xxhash64("digest"), parts)
    dealt = visits.join(sizes, ["dim", "cell"])
    # A member meets every block of visitors, a visitor every block of members.
    seen = dealt.select(
        "digest", "dim", "home", "cell", F.lit(False).alias("member"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("m"), spot(F.col("v")).alias("v"),
    )
    lying = dealt.filter("cell = home").select(
        "digest", "dim", "home", "cell", F.lit(True).alias("member"),
        spot(F.col("m")).alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("v") - 1)).alias("v"),
    )
    blocks = seen.unionByName(lying).join(classes.select("digest", "copies", "vector"), "digest")
    found = written(
        blocks.groupBy("dim", "cell", "m", "v").applyInPandas(
            _compare(books, dtype, cosine), "digest binary, links long, root binary"
        ),
        "links",
    )
    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    edges = found.filter("digest <> root").select(F.col("digest").alias("src"), F.col("root").alias("dst"))
    components = connected_components(edges.distinct()).select(
        F.col("node").alias("digest"), F.col("component").alias("label")
    )
    nodes = written(
        classes.select("digest", "id", "copies")
        .join(counts, "digest", "left")
        .join(components, "digest", "left")
        .select(
            "digest",
            "id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("label", "digest").alias("label"),
        ),
        "nodes",
    )
    least = nodes.groupBy("label").agg(F.min("id").alias("least"))
    named = nodes.join(least, "label").select("digest", "n_links", "least")
    return (
        packed.select("id", "digest")
        .join(named, "digest", "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
        )
    )


def _fit(classes: DataFrame, n: int, dtype: str, cosine: float, recall: float) -> dict[int, Codebooks]:
    """Codebooks by vector length, from the sample of the smallest digests."""
    words = min(MOST_WORDS, max(1, math.ceil(math.sqrt(n / ROWS_PER_CELL))))
    sample = classes.select("digest", "vector").orderBy("digest").limit(words * SAMPLE_PER_WORD)
    size = np.dtype(dtype).itemsize
    by_dim: dict[int, list[bytes]] = {}
    for row in sample.collect():
        by_dim.setdefault(len(row["vector"]) // size, []).append(bytes(row["vector"]))
    return {
        dim: Codebooks(_unit(packed, dtype), words, cosine, recall) for dim, packed in by_dim.items()
    }
