"""Repeated passages, removed line by line.

Texts are cut into units at line ends and, so that a passage pasted into the middle of a line is
seen too, at sentence ends and before capitals that follow white space after a lower-case word.
Short units repeat by chance, so what is hashed are windows of neighbouring units: from every unit
the fewest to either side that have ``least`` words. Words are normalised (case, marks and white
space don't matter). Digests are grouped over the whole corpus; the first occurrence by (id,
position) stays and every later one is removed. Windows that meet are one run. Every sequence of
units that occurs earlier as a sequence and has ``least`` words is covered by its windows.

Units depend on case, marks and neighbours of a passage. So texts are also cut where the words
themselves say so: before the pair of words whose hash is the least of ``NEAR`` neighbouring pairs.
Any ``NEAR + 1`` words hold such a cut whatever stands around them, and windows between these cuts
are hashed as those between units are. A passage of 50 words holds whole windows wherever it is
pasted; without units of its own it goes but for less than ``NEAR + 1`` words at either end. A
word that follows itself has no cut, so a run of one word is one piece.
Offsets are those of the original text.

Almost all windows occur once, so they are counted first by 64 bits of their digest alone. Those
counted twice set one bit each of a filter of fixed size (``FILTER_BITS``), which every task gets;
the texts are read again and only windows that the filter passes are written, with both halves of
their digest, place and text. These are grouped by the whole digest and joined back, so the result
is exact however full the filter is; where it is full, it only spares less. A window that a third of
all texts hold is a large group in no task: counts and smallest ids are partial sums, never lists,
and adaptive execution splits the join. What a text repeats of its own is marked where it is read.

Defined results: NULL and empty texts and lines without words have no units. Rows with one id rank
alike and remove nothing of each other, so that rows repeated as a whole don't remove themselves. A
NULL id ranks last, and such rows remove nothing of each other. Further columns are kept, whatever
their names; one named ``removed`` is replaced.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm.tables import fingerprint, whole_texts, written
from tagloom.session import small_side

LEAST_WORDS = 10
NEAR = 16
FILTER_BITS = 26  # the filter takes 2 to this power bits: 8 MB
BLOCK = 1 << 18  # characters or words that are hashed at a time

_NUMBERS = ["again", "words", "chars", "units", "a", "b"]
_IN_WORD, _LINE_END, _SPACE, _MARK, _LOWER, _CAPITAL = 1, 2, 4, 8, 16, 32


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """What every character is, as bits, and its lower case; both sigmas count as one."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    case = {"Ll": _LOWER, "Lu": _CAPITAL, "Lt": _CAPITAL}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalnum():
            kinds[code] = _IN_WORD | case.get(unicodedata.category(char), 0)
            small = char.lower()
            if small != char and len(small) == 1:
                lower[code] = ord(small)
        elif char.isspace():
            kinds[code] = _SPACE
    for char, kind in (("_", _IN_WORD), ("\n", _LINE_END), (".", _MARK), ("!", _MARK), ("?", _MARK)):
        kinds[ord(char)] = kind
    lower[ord("ς")] = ord("σ")
    return kinds, lower


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, step: int) -> np.ndarray:
    """For every range of ``values``, the sum of hashes of its values with their places in it."""
    out = np.empty(len(starts), np.uint64)
    sizes = stops - starts
    total = np.cumsum(sizes)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + BLOCK, side="right")))
        size = sizes[at:to]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        terms = values[np.repeat(starts[at:to], size) + place].astype(np.uint64)
        terms += (place.astype(np.uint64) + np.uint64(1)) * np.uint64(step)
        out[at:to] = np.add.reduceat(_mixed(terms), first)
        at = to
    return out


class _Cuts:
    """The words of a text, as hashes, and its units, in characters and in words."""

    def __init__(self, text: str):
        kinds, lower = _characters()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = kinds[codes]
        edges = np.diff((kind & _IN_WORD).astype(np.int8), prepend=0, append=0)
        self.starts, self.stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.words = _mixed(_sums(lower[codes], self.starts, self.stops, 0x9E3779B97F4A7C15))
        # A unit ends at line ends, at white space after a sentence mark, and at white space
        # between a lower-case letter and a capital.
        space = kind & (_LINE_END | _SPACE)
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        at, to = np.concatenate(([0], turns)), np.concatenate((turns, [len(codes)]))
        around = np.pad(kind, 1)
        before, behind, run = around[at], around[to + 1], around[at + 1]
        case = ((before & _LOWER) > 0) & ((behind & _CAPITAL) > 0)
        ends = (run == _LINE_END) | ((run == _SPACE) & (((before & _MARK) > 0) | case))
        unit_starts = np.concatenate(([0], to[ends]))
        unit_stops = np.concatenate((at[ends], [len(codes)]))
        reached = np.searchsorted(self.starts, unit_stops)
        full = np.diff(reached, prepend=0) > 0  # units without words are none
        self.unit_starts, self.unit_stops = unit_starts[full], unit_stops[full]
        self.bounds = np.concatenate(([0], reached[full]))

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64 bits for every range of words, from sums over all words before its ends."""
        base = np.full(len(self.words) + 1, 0xD1342543DE82EF95, np.uint64)
        back = np.full(len(self.words) + 1, pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * np.multiply.accumulate(base)[:-1], out=sums[1:])
        size = (last - first).astype(np.uint64)
        return _mixed((sums[last] - sums[first]) * np.multiply.accumulate(back)[first] + size)


def units(text: str | None) -> list[tuple[int, int, int, int]]:
    """``(start, end, first word, last word + 1)`` of the units that have a word."""
    if not text:
        return []
    cuts = _Cuts(text)
    columns = (cuts.unit_starts, cuts.unit_stops, cuts.bounds[:-1], cuts.bounds[1:])
    return list(zip(*[c.tolist() for c in columns], strict=True))


def _windows(bounds: np.ndarray, least: int) -> list[np.ndarray]:
    """The shortest windows of ``least`` words from every bound to the next and previous ones.

    Bounds at both ends of a window are one number, the first in the upper half.
    """
    last = np.searchsorted(bounds, bounds + least)
    first = np.searchsorted(bounds, bounds - least, side="right") - 1
    on, back = last < len(bounds), first >= 0
    return [bounds[on] << 32 | bounds[last[on]], bounds[first[back]] << 32 | bounds[back]]


def _content_cuts(words: np.ndarray) -> np.ndarray:
    """Words before which the least pair hash of ``NEAR`` neighbours puts a cut."""
    if len(words) <= NEAR:
        return np.zeros(0, np.int64)
    pair = _mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    near = np.lib.stride_tricks.sliding_window_view(pair, NEAR)
    cuts = np.zeros(len(pair), bool)
    for at in range(0, len(near), 65_536):  # bounds what a long text takes
        some = near[at : at + 65_536]
        cuts[np.arange(at, at + len(some)) + some.argmin(axis=1)] = True
    cuts[1:] &= pair[1:] != pair[:-1]
    return np.flatnonzero(cuts)


def _all_windows(cuts: _Cuts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and words behind them, in order."""
    found = _windows(cuts.bounds, least) + _windows(_content_cuts(cuts.words), least)
    grid = np.unique(np.concatenate(found))
    return grid >> 32, grid & 0xFFFFFFFF


def _counted(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The digests of all windows, each once a text."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what many windows of a batch take
                found = [np.zeros(0, np.uint64)]
                for text in batch.column(0).slice(at, 512):
                    if text.as_py():
                        cuts = _Cuts(text.as_py())
                        found.append(np.unique(cuts.digests(*_all_windows(cuts, least))))
                digests = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([digests], names=["a"])

    return rows_of


def _window_rows(
    least: int, passed: Callable[[np.ndarray], np.ndarray]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows whose digests the filter passes or their own text repeats."""

    def windows_of(text: str) -> np.ndarray:
        cuts = _Cuts(text)
        first, last = _all_windows(cuts, least)
        a = cuts.digests(first, last)
        _, of, times = np.unique(a, return_inverse=True, return_counts=True)
        some = np.flatnonzero(passed(a) | (times[of] > 1))
        first, last, a = first[some], last[some], a[some]
        b = _sums(cuts.words, first, last, 0xC2B2AE3D27D4EB4F)
        _, earliest = np.unique(np.stack((a, b)), axis=1, return_index=True)
        again = np.ones(len(a), np.int64)
        again[earliest] = 0
        starts, stops = cuts.starts.copy(), cuts.stops.copy()  # those of a unit with its marks
        starts[cuts.bounds[:-1]] = cuts.unit_starts
        stops[cuts.bounds[1:] - 1] = cuts.unit_stops
        unit = np.searchsorted(cuts.bounds, first, side="right") - 1
        unit_end = np.searchsorted(cuts.bounds, last)
        places = (first << 32 | last, starts[first] << 32 | stops[last - 1], unit << 32 | unit_end)
        return np.stack((again, *places, a.view(np.int64), b.view(np.int64)))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what many windows of a batch take
                some = batch.slice(at, 512)
                texts = [(k, t.as_py()) for k, t in enumerate(some.column(2))]
                found = [(k, windows_of(t)) for k, t in texts if t]
                of = pa.array(np.repeat([k for k, _ in found], [g.shape[1] for _, g in found]).astype(np.int64))
                grid = np.concatenate([np.zeros((len(_NUMBERS), 0), np.int64), *[g for _, g in found]], axis=1)
                columns = [some.column(0).take(of), some.column(1).take(of), *map(pa.array, grid)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", *_NUMBERS])

    return rows_of


def _filter_of(digests: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that every digest passes and few others: one bit each of ``2 ** FILTER_BITS``.

    What reaches the driver and every task is bounded by the number of bits, not by the digests.
    """
    bit = F.shiftrightunsigned("a", 64 - FILTER_BITS)
    words = (
        digests.select(bit.alias("bit"))
        .selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, int(bit & 63)) AS bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = digests.sparkSession.sparkContext.broadcast(table)

    def passed(a: np.ndarray) -> np.ndarray:
        bit = a >> np.uint64(64 - FILTER_BITS)
        return (shared.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    return passed


def _later(found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose digest an earlier id, or their own text, has as well."""
    new = found.filter("again = 0").drop("again")
    groups = (
        new.groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .filter("n > 1")
        .select("a", "b", "first_id")
    )
    repeated = new.join(groups, ["a", "b"]).filter(~F.col("id").eqNullSafe(F.col("first_id")))
    return repeated.select(*columns).unionByName(found.filter("again = 1").select(*columns))


def repeated_passages(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS
) -> DataFrame:
    """``(id, mark, start, end, units, words)``: what to remove, one row per run of a text."""
    rows = docs.select(F.col(id).cast("long").alias("id"), fingerprint(F.col(text)).alias("mark"), text)
    whole_texts(docs.sparkSession)
    twice = rows.select(text).mapInArrow(_counted(least), "a long").groupBy("a").count().filter("count > 1")
    types = "id long, mark long, " + ", ".join(f"{n} long" for n in _NUMBERS)
    found = written(rows.mapInArrow(_window_rows(least, _filter_of(twice)), types), "windows")
    later = _later(found, ["id", "mark", "words", "chars", "units"])
    low = lambda c: F.shiftright(c, 32)
    high = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    # Windows that overlap or meet are one run; a row repeated as a whole adds none.
    text_order = Window.partitionBy("id", "mark").orderBy("words")
    reach = F.max(high("words")).over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        later.withColumn("new_run", F.coalesce(low("words") > reach, F.lit(True)).cast("long"))
        .withColumn("run", F.sum("new_run").over(text_order))
        .groupBy("id", "mark", "run")
        .agg(
            F.min(low("chars")).alias("start"),
            F.max(high("chars")).alias("end"),
            (F.max(high("units")) - F.min(low("units"))).alias("units"),
            (F.max(high("words")) - F.min(low("words"))).alias("words"),
        )
        .drop("run")
    )


def cut(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without some spans; what stood on either side keeps its white space."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for span in spans:
        parts.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*parts, text[at:]])


def _cut_all(texts: pa.Array, spans: pa.Array) -> pa.Array:
    pairs = zip(texts, spans, strict=True)
    return pa.array([cut(t.as_py(), s.as_py()) for t, s in pairs], pa.string())


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS
) -> DataFrame:
    """``docs`` without repeated runs, and ``removed``: their original offsets, in order."""
    runs = repeated_passages(docs, id=id, text=text, least=least)
    spans = written(
        runs.groupBy(F.col("id").alias("cut__id"), F.col("mark").alias("cut__mark")).agg(
            F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut__spans")
        ),
        "spans",
    )
    # The caller's columns in one, so that none of their names meets ours.
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id].cast("long").alias("id"),
        fingerprint(docs[text]).alias("mark"),
    )
    here = F.col("cut__id").eqNullSafe(F.col("id")) & (F.col("cut__mark") == F.col("mark"))
    joined = packed.join(small_side(spans), here, "left")
    row = F.col("row")
    cut_text = F.arrow_udf(_cut_all, "string")(row[text], F.col("cut__spans"))
    left = [(cut_text if c == text else row[c]).alias(c) for c in docs.columns if c != "removed"]
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(*left, F.coalesce("cut__spans", none).alias("removed"))
