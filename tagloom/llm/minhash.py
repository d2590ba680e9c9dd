"""Near-duplicate documents by circulant MinHash and exact verification.

Li and Li, "C-MinHash: Improving Minwise Hashing with Circulant Permutation" (ICML 2022): one
permutation shuffles the shingle ids, a second one is shifted by k to give the k-th coordinate.
Here both permute the 64-bit numbers: invertible mixers, so that coordinate k is
``min(pi(sigma(x) - k))``.

The job, each step over all documents:

1. Each text becomes its set of shingle hashes; the row keeps the set's size, digest and band keys.
2. Equal sets are one class: copies cost one aggregate and no comparison.
3. Classes that share a band key are compared with the bucket's smallest class, a star instead of
   all pairs. The comparison is exact, on full sets.
4. Buckets that still hold several components may hide links away from their centre. The classes
   that share such buckets with a centre are dealt into blocks, and every class outside the largest
   component is compared with all others there, exactly and inside a task: what comes out is one
   link to each component that it reaches, never the pairs.

With 25 bands of 5 a pair at 0.85 is missed with a chance of 4e-7, at 0.9 of 1e-10.

Defined results: no words (NULL, empty, blank): an empty set, linked with nothing. Rows of equal
text are copies, whatever their ids. A NULL id is no candidate for the smallest id of a component;
without any other it stays NULL. Further columns never enter the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.tables import fingerprint, whole_texts, written
from tagloom.operators.components import connected_components
from tagloom.session import small_side

BANDS, ROWS = 25, 5
# Classes on the left of a block pair, and about how many shingles on its right.
LEFT_CLASSES, RIGHT_SHINGLES = 2048, 2_000_000
_U = np.uint64
# Elements of one block of coordinates: stays in a core's cache.
_BLOCK = 1 << 16


def _mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 64-bit numbers, in place."""
    x ^= x >> _U(32)
    x *= _U(a)
    x ^= x >> _U(29)
    x *= _U(b)
    x ^= x >> _U(32)
    return x


def _sigma(x: np.ndarray) -> np.ndarray:
    return _mix(x, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _pi(x: np.ndarray) -> np.ndarray:
    return _mix(x, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted 64-bit hashes; only A-Z is lower-cased."""
    found = (text or b"").lower().split()  # bytes: ASCII letters, and space and 9 to 13 as space
    if not found:
        return np.empty(0, _U)
    if len(found) < words:
        whole = xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)
        return np.array([whole], _U)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    n = len(found) - words + 1
    shingle = word[:n].copy()
    for k in range(1, words):
        shingle = _sigma(shingle) + word[k : k + n]
    return np.unique(_pi(shingle))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinates 0 to ``size - 1``: two permutations, the second one shifted."""
    base = _sigma(shingles.copy())
    shift = np.arange(size, dtype=_U)[:, None]
    least = np.full(size, np.iinfo(_U).max, _U)
    step = max(1, _BLOCK // size)
    for at in range(0, len(base), step):
        np.minimum(least, _pi(base[at : at + step] - shift).min(axis=1), out=least)
    return least


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = coordinates.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=_U)
    for k in range(rows):
        keys = _sigma(keys) + grid[:, k]
    return _pi(keys).view(np.int64)


_SIGNED = pa.schema(
    [
        ("id", pa.int64()),
        ("mark", pa.int64()),
        ("n", pa.int64()),
        ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
    ]
)


def _sign(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(2):
                shingles = shingle_hashes(text.as_py(), words)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                some = len(shingles) > 0
                coordinates = signature(shingles, bands * rows) if some else None
                keys.append(band_keys(coordinates, bands, rows) if some else [])
            columns = [batch.column(0), batch.column(1), sizes, digests, keys]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SIGNED)

    return sign


def _sets(words: int):
    out = pa.schema([("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found = {}, []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in digests:
                    digests[digest] = len(found)
                    found.append(shingle_hashes(text.as_py(), words).view(np.int64))
            arrays = [pa.array(list(digests), out.field(0).type), pa.array(found, out.field(1).type)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return sets


def _rows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id).cast("long").alias("id"),
        fingerprint(F.col(text)).alias("mark"),
        F.col(text).cast("binary").alias("text"),
    )


class _Classes:
    """Distinct shingle sets of a table, and exact comparisons between them."""

    def __init__(self, rows: DataFrame, words: int, percent: int, bands: int, width: int):
        whole_texts(rows.sparkSession)
        self.rows, self.words, self.percent = rows, words, percent
        types = "id long, mark long, n long, digest binary, bands array<long>"
        self.signed = written(rows.mapInArrow(_sign(words, bands, width), types), "signed")
        # One row that has each digest: where its text can be read again.
        self.table = written(
            self.signed.filter("n > 0")
            .groupBy("digest")
            .agg(
                F.min(F.struct("id", "mark")).alias("at"),
                F.min("id").alias("least_id"),
                F.first("n").alias("n"),
                F.first("bands").alias("bands"),
            )
            .select("digest", "n", "bands", "at.id", "at.mark", "least_id"),
            "classes",
        )

    def members(self) -> DataFrame:
        """``(key, digest, n)`` of the buckets that hold two classes or more."""
        members = self.table.select(F.explode("bands").alias("key"), "digest", "n")
        shared = members.groupBy("key").count().filter("count > 1").select("key")
        return written(members.join(shared, "key"), "members")

    def sets_of(self, digests: DataFrame) -> DataFrame:
        """``(digest, shingles)`` of some classes, from the texts themselves."""
        wanted = written(self.table.join(digests, "digest", "left_semi"), "wanted")
        wanted = wanted.select("digest", F.col("id").alias("i"), F.col("mark").alias("m"))
        texts = self.rows.join(
            small_side(wanted), F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
        ).select("digest", "text")
        found = texts.mapInArrow(_sets(self.words), "digest binary, shingles array<long>")
        # A row may be repeated in the input.
        return written(found.groupBy("digest").agg(F.first("shingles").alias("shingles")), "sets")

    def fits(self, a: Column, b: Column) -> Column:
        """Sizes that allow the threshold at all."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs ``(src, dst)`` whose full sets reach the threshold."""
        side = lambda end: sets.select(
            F.col("digest").alias(end), F.col("shingles").alias(f"{end}_set")
        )
        both = pairs.join(side("dst"), "dst").join(side("src"), "src")
        common = F.size(F.array_intersect("src_set", "dst_set"))
        union = F.size("src_set") + F.size("dst_set") - common
        return both.filter(common * 100 >= union * self.percent).select("src", "dst")


def _star(members: DataFrame, fits) -> DataFrame:
    """Every member of a bucket with the bucket's smallest class."""
    centres = members.groupBy("key").agg(F.min("digest").alias("src"))
    sized = centres.join(
        members.select("key", F.col("digest").alias("src"), F.col("n").alias("src_n")), ["key", "src"]
    )
    return (
        members.withColumnRenamed("digest", "dst")
        .join(sized, "key")
        .filter((F.col("src") != F.col("dst")) & fits(F.col("src_n"), F.col("n")))
        .select("src", "dst")
        .distinct()
    )


def _labelled(table: DataFrame, components: DataFrame) -> DataFrame:
    parts = components.select(F.col("node").alias("digest"), F.col("component").alias("label"))
    return table.join(parts, "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _blocks(members: DataFrame, open_keys: DataFrame, components: DataFrame) -> DataFrame:
    """Classes around each centre, dealt into pairs of blocks ``(centre, l, r)``.

    The left side has the classes outside the centre's largest component, the right side has all.
    """
    centres = members.groupBy("key").agg(F.min("digest").alias("centre"))
    around = members.join(open_keys, "key", "left_semi").join(centres, "key")
    around = around.select("centre", "digest", "n").distinct()
    around = written(_labelled(around, components), "around")
    labels = around.groupBy("centre", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    plan = (
        labels.groupBy("centre")
        .agg(
            F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("c"), F.sum("t").alias("t")
        )
        .select(
            "centre",
            F.col("most.label").alias("major"),
            (F.col("c") - F.col("most.c")).alias("minors"),
            F.ceil(F.col("t") / RIGHT_SHINGLES).alias("rs"),
        )
        .filter("minors > 0")
        .withColumn("ls", F.ceil(F.col("minors") / LEFT_CLASSES))
    )
    dealt = around.join(plan, "centre")
    spot = lambda parts: F.pmod(F.xxhash64("digest"), parts)
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    shown = ["centre", "digest", "label"]
    left = dealt.filter("label <> major").select(
        *shown, F.lit(True).alias("left"), spot(F.col("ls")).alias("l"), every("rs").alias("r")
    )
    right = dealt.select(
        *shown, F.lit(False).alias("left"), every("ls").alias("l"), spot(F.col("rs")).alias("r")
    )
    return left.unionByName(right)


def _links_between(left: list[tuple], right: list[tuple], percent: int) -> Iterator[tuple]:
    """``(digest, digest)``: a link from each left class to each other component it reaches."""
    if not left or not right:
        return
    sizes = np.array([len(c[2]) for c in right])
    flat = np.concatenate([c[2] for c in right])
    tokens, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names = {label: k for k, label in enumerate(sorted({c[1] for c in right}))}
    labels = np.array([names[c[1]] for c in right])
    held = np.zeros(len(tokens), np.int64)
    for digest, label, shingles in left:
        at = np.searchsorted(tokens, shingles)
        at = at[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == shingles)]
        held[at] = 1
        common = np.add.reduceat(held[flat], starts)
        held[at] = 0
        union = len(shingles) + sizes - common
        near = (100 * common >= percent * union) & (labels != names.get(label, -1))
        reached, first = np.unique(labels[near], return_index=True)
        for k in np.flatnonzero(near)[first]:
            yield digest, right[k][0]


def _compare(percent: int):
    """Links within the block pairs of a partition, whose rows come sorted by block pair."""
    out = pa.schema([("src", pa.binary()), ("dst", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            rest = (batch.column(c).to_pylist() for c in range(3, 6))
            sets = (x.values.to_numpy() for x in batch.column(6))
            yield from zip(keys, *rest, sets, strict=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in groupby(rows(batches), key=itemgetter(0)):
            sides: dict[bool, list[tuple]] = {True: [], False: []}
            for _, is_left, digest, label, shingles in block:
                sides[is_left].append((digest, label, shingles))
            if links := list(_links_between(sides[True], sides[False], percent)):
                arrays = [pa.array(c, pa.binary()) for c in zip(*links, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return compare


def _rest(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    columns = ["centre", "l", "r", "left", "digest", "label", "shingles"]
    both = blocks.join(sets, "digest").select(*columns)
    dealt = both.repartition("centre", "l", "r").sortWithinPartitions("centre", "l", "r")
    return dealt.mapInArrow(_compare(percent), "src binary, dst binary")


def near_duplicates(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(id, mark, n_shingles, component_id, component)`` per row of ``docs``.

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``words``-word
    shingles. ``component_id`` is the smallest id reachable by links and ``component`` names the
    component itself (NULL without words); ``mark`` is the text's fingerprint, which with the id
    names the row.
    """
    classes = _Classes(_rows_of(docs, id, text), words, percent, bands, rows)
    members = classes.members()

    pairs = written(_star(members, classes.fits), "star")
    ends = pairs.select(F.col("src").alias("digest")).union(pairs.select("dst")).distinct()
    links = written(classes.linked(pairs, classes.sets_of(ends)), "links")
    components = connected_components(links)

    labelled = _labelled(members, components)
    open_keys = (
        labelled.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("label").alias("a"), F.max("label").alias("b"))
        .filter("size > 2 AND a <> b")
        .select("key")
    )
    open_keys = written(open_keys, "open")
    rest = members.join(open_keys, "key", "left_semi").select("digest").distinct()
    found = _rest(_blocks(members, open_keys, components), classes.sets_of(rest), percent)
    components = connected_components(written(links.unionByName(found), "all_links"))

    nodes = _labelled(classes.table.select("digest", "least_id"), components)
    nodes = written(nodes, "nodes")
    least = nodes.groupBy("label").agg(F.min("least_id").alias("least"))
    named = nodes.join(least, "label").select("digest", "least", F.hex("label").alias("component"))
    return (
        classes.signed.select("id", "mark", "n", "digest")
        .join(named, "digest", "left")
        .select(
            "id",
            "mark",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
            "component",
        )
    )


def drop_near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """``docs`` with one row of each component: the one that has the component's smallest id.

    Texts without words are no duplicates and all stay. Rows repeated as a whole leave one.
    """
    rows = near_duplicates(docs, id=id, text=text, **settings).filter("n_shingles > 0")
    keys = written(rows.groupBy("component", "id", "mark").agg(F.count("*").alias("copies")), "keys")
    order = F.struct(F.col("id").isNull(), "id", "mark")
    first = keys.groupBy("component").agg(F.min(order).alias("first"))
    judged = written(
        keys.join(first, "component").select(
            F.col("id").alias("near__id"),
            F.col("mark").alias("near__mark"),
            (order == F.col("first")).alias("near__kept"),
            (F.col("copies") > 1).alias("near__repeated"),
        ),
        "judged",
    )
    here = F.col("near__id").eqNullSafe(docs[id].cast("long")) & (
        F.col("near__mark") == fingerprint(docs[text])
    )
    gone = small_side(judged.filter("NOT near__kept OR near__repeated"))
    single = docs.join(gone, here, "left_anti")
    again = small_side(judged.filter("near__kept AND near__repeated"))
    repeated = docs.join(again, here).select(
        "near__id", "near__mark", F.struct(*docs.columns).alias("near__row")
    )
    one = repeated.groupBy("near__id", "near__mark").agg(F.min("near__row").alias("near__row"))
    return single.unionByName(one.select("near__row.*"))
