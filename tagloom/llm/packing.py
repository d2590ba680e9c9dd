"""Packing tokenized documents into sequences of even attention cost.

Attention costs a sequence about ``linear * n + quadratic * n * n`` for every piece of n tokens in
it. Documents are taken in descending length and each goes to the sequence of the lowest cost so far
that has room for it. What fits nowhere is cut to the most roomy sequence, so that every sequence is
filled to the end.

Each task packs the documents it reads, a window of sequences at a time: nothing is shuffled, a
task holds one window, and a lost task is packed again from its own input alone. What a window can't
place goes to the next one; the last tokens of a partition fill sequences of powers of two, which
need no padding. Input should be a written table, or come in a fixed order otherwise, so that a
repeated task cuts alike.

Defined results: NULL and empty texts are one token, the end mark. Rows repeated as a whole are
packed one by one. Partitions without rows give nothing. Further columns are left out.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tagloom.llm.tables import whole_texts

END = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
WINDOW = 256
# Entries of one of the two generations of a worker's token cache, and the longest piece it keeps.
CACHE, CACHED_CHARS = 200_000, 32
# Text, in bytes, that is encoded at once; a longer text goes alone.
AT_ONCE = 4 << 20
# Words of these letters are one piece to the tokenizer, and compose with nothing. ASCII marks behind
# them are one piece more, whatever they are; an apostrophe may start a piece of its own.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = f"^{_LETTERS}[{re.escape(_MARKS)}]*$"
# Byte-level vocabularies write a byte that isn't a visible Latin-1 character as one from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - _VISIBLE))}
# What the short ways are tried on before they are used with a tokenizer.
_TRIAL = "The QUICK brown-fox, Élan naïve Straße ÀÿØ; end. don't it's x*** (so) [a] 12ab ÑANDÚ!! a_b"


class _Pieces(dict):
    """Token ids by text piece, made when first asked for.

    ``before`` is the generation that this one replaces: what is still in use moves over from it,
    and the rest goes with it.
    """

    def __init__(self, ids: Callable[[str], list[int]], before: _Pieces | None = None):
        super().__init__()
        self.ids = ids
        self.before: dict = before if before is not None else {}
        if before is not None:
            before.before = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.before.get(piece)) is None:
            found = self.ids(piece)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


def _looked_up(pieces: _Pieces, words: pa.Array) -> pa.Array:
    words = words.to_numpy(zero_copy_only=False).tolist()
    return pa.array([pieces[w] for w in words], pa.large_binary())


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    Where the tokenizer never looks across white space, a text's ids are those of its pieces between
    ASCII white space in a row. Pieces come again and again, so the distinct ones of many texts are
    found first, tokenized once and kept. Plain Latin words, also with marks at the end, go to the
    vocabulary directly: all that a lower-casing byte-level tokenizer's earlier steps do to them is lower
    case and splitting off the marks. Both are tried on a fixed text when a tokenizer is loaded, and left
    out if a single id differs.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are Spark's to share
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = np.array([end], "<u4").tobytes()
        self.pieces, self.plain = _Pieces(self._whole), _Pieces(self._direct)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        want = self._whole(_TRIAL)
        words = _TRIAL.split()
        self.by_word = want == [i for w in words for i in self._whole(w)] and not any(
            set(t) & set(" \t\n\v\f\r") for t in added
        )
        found = pa.array(words, pa.string())
        self.direct = (
            self.by_word
            and self._trial(found) == want
            and not any(set(t) <= set(_MARKS) or re.fullmatch(_PLAIN, t) for t in added)
        )

    def _trial(self, words: pa.Array) -> list[int]:
        """Ids by way of the vocabulary; none if it lacks a letter."""
        try:
            ids = b"".join(self._ids(words, direct=True).to_pylist())
        except Exception:  # noqa: BLE001 - a vocabulary that can't be asked like this isn't
            ids = b""
        self.pieces.clear()
        self.plain.clear()
        return np.frombuffer(ids, "<u4").tolist()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, piece: str) -> list[int]:
        """Ids of letters in lower case, or of marks."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _ids(self, words: pa.Array, direct: bool) -> pa.Array:
        """Ids of different words."""
        if not direct:
            return _looked_up(self.pieces, words)
        plain = pc.match_substring_regex(words, _PLAIN)
        rest = words.filter(pc.invert(plain))
        words = words.filter(plain)
        letters = pc.ascii_rtrim(words, _MARKS)
        marked = pc.not_equal(pc.binary_length(letters), pc.binary_length(words))
        marks = pc.replace_with_mask(pc.if_else(marked, words, ""), marked, pc.replace_substring_regex(words.filter(marked), _LETTERS, ""))
        parts = []
        for part in (pc.utf8_lower(letters), marks):
            part = part.dictionary_encode()
            parts.append(_looked_up(self.plain, part.dictionary).take(part.indices))
        ids = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        others = _looked_up(self.pieces, rest)
        # Back to the order of the words.
        first = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        then = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        place = np.empty(len(plain), np.int64)
        place[first] = np.arange(len(first))
        place[then] = len(first) + np.arange(len(then))
        return pa.concat_arrays([ids, others]).take(pa.array(place))

    def encode(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Ids of texts, each followed by the end mark; texts may come in UTF-8 as well."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids = (self._whole(t.as_py()) for t in texts)
            return [struct.pack(f"<{len(i)}I", *i) + self.end for i in ids]
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._ids(words.dictionary, self.direct).take(words.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :]
        starts = bounds[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))].tolist()
        held = memoryview(ids.buffers()[2] or b"")
        found = [bytes(held[a:b]) + self.end for a, b in zip(starts, starts[1:], strict=False)]
        if len(self.pieces) > CACHE:
            self.pieces = _Pieces(self._whole, self.pieces)
        if len(self.plain) > CACHE:
            self.plain = _Pieces(self._direct, self.plain)
        return found


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(first, rows)`` of neighbouring texts of ``AT_ONCE`` bytes together; a longer text goes alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first = held = 0
    for at, size in enumerate(sizes):
        if at > first and held + size > AT_ONCE:
            yield first, at - first
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes) - first


def encoder(path: str, end: int) -> Encoder:
    """This worker's encoder: tasks of one worker share its cache.

    Functions of this package travel by value and have new globals in every task, so the cache
    belongs to a module that only the worker has.
    """
    shared = vars(sys.modules.setdefault("_tagloom_encoders", ModuleType("_tagloom_encoders")))
    if (path, end) not in shared:
        shared[path, end] = Encoder(path, end)
    return shared[path, end]


Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def assign(
    pieces: list[tuple[int, int, int]], capacities: list[int], linear: float, quadratic: float
) -> tuple[list[Piece], list[tuple[int, int, int]]]:
    """Pieces ``(document, start, length)`` placed in sequences, and those left when all are full."""
    room = np.array(capacities, np.int64)
    used = np.zeros(len(capacities), np.int64)
    cost = np.zeros(len(capacities))
    waiting = [(-n, doc, start) for doc, start, n in pieces]
    heapq.heapify(waiting)
    placed, free = [], int(room.sum())
    while waiting and free:
        length, doc, start = heapq.heappop(waiting)
        n = -length
        fits = room >= n
        if fits.any():
            at = int(np.where(fits, cost, np.inf).argmin())
        else:
            at = int(room.argmax())
            heapq.heappush(waiting, (int(room[at]) - n, doc, start + int(room[at])))
            n = int(room[at])
        placed.append((doc, start, n, at, int(used[at])))
        used[at] += n
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
        free -= n
    return placed, sorted((doc, start, -n) for n, doc, start in waiting)


def powers_of_two(n: int) -> list[int]:
    """Descending powers of two that add up to ``n``."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class _Window:
    """Documents waiting for a sequence, and the numbers of the sequences made so far."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first: int):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.next = first
        self.ids: dict[int, tuple[object, bytes]] = {}
        self.pieces: list[tuple[int, int, int]] = []
        self.tokens = self.count = 0

    def add(self, key: object, ids: bytes) -> list[tuple]:
        doc, n = self.count, len(ids) // 4
        self.count += 1
        self.ids[doc] = (key, ids)
        whole = n - n % self.capacity
        rows = []
        for start in range(0, whole, self.capacity):  # fills sequences by itself
            rows.append(self._row((doc, start, self.capacity, 0, 0)))
            self.next += 1
        if n > whole:
            self.pieces.append((doc, whole, n - whole))
            self.tokens += n - whole
        else:
            del self.ids[doc]
        return rows

    def _row(self, piece: Piece) -> tuple:
        doc, start, n, sequence, offset = piece
        key, ids = self.ids[doc]
        part = ids[4 * start : 4 * (start + n)]
        return key, start, n, len(ids) // 4, self.next + sequence, offset, part

    def pack(self, last: bool) -> list[tuple]:
        capacities = [self.capacity] * (self.tokens // self.capacity)
        if last:
            capacities += powers_of_two(self.tokens % self.capacity)
        placed, left = assign(self.pieces, capacities, self.linear, self.quadratic)
        rows = [self._row(p) for p in placed]
        self.next += len(capacities)
        self.pieces = left
        self.tokens = sum(n for _, _, n in left)
        self.ids = {doc: self.ids[doc] for doc in {p[0] for p in left}}
        return rows


def _packer(path: str, end: int, capacity: int, window: int, linear: float, quadratic: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, end)
        first = TaskContext.get().partitionId() << 36
        waiting = _Window(capacity, linear, quadratic, first)
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [kind] + [pa.int64()] * 5 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

        for batch in batches:
            kind = batch.column(0).type
            for at, n in portions(batch.column(1)):
                some = batch.slice(at, n)
                rows = []
                for key, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1)), strict=True):
                    rows += waiting.add(key, ids)
                if waiting.tokens >= window * capacity:
                    rows += waiting.pack(last=False)
                if rows:
                    yield out(rows)
        if waiting.pieces:
            yield out(waiting.pack(last=True))

    return pack


_NAMES = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    end: int = END,
    capacity: int = 4096,
    window: int = WINDOW,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: where it comes from, where it lies, and its token ids.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. ``ids`` holds
    little-endian unsigned 32-bit numbers. Sequences are numbered apart in each partition.
    """
    long = T.LongType()
    schema = T.StructType(
        [T.StructField(id, docs.schema[id].dataType)]
        + [T.StructField(n, long) for n in _NAMES[1:-1]]
        + [T.StructField("ids", T.BinaryType())]
    )
    whole_texts(docs.sparkSession)
    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, end, capacity, window, linear, quadratic), schema)
