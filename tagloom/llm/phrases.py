"""Collocations: phrases of 2 to 4 words that occur together more than their parts suggest.

SON partitioning (Savasere, Omiecinski and Navathe, 1995). Texts are read in shards, one a task.
Each shard is mined completely at its share of the support: ``ceil(support * its bytes / all
bytes)`` by language. What shards may leave out at these limits adds up to less than the support, so
a phrase that is frequent in all is frequent in at least one shard. A shard is mined level by
level on arrays: a phrase is counted only where the two phrases it overlaps by all but one word are
frequent in the shard.

The locally frequent phrases are united by a 64-bit hash; runs of hashes and counts travel packed,
so the shuffle takes about six bytes a phrase and shard. Where a shard didn't name a phrase, it holds
less than its local support; phrases that can't reach the support even so are left out. The others
are marked in a bit table of fixed size, which every task gets, and a second scan counts all marked
phrases as words, exactly. Hash collisions and a full bit table only add phrases that the exact
counts drop, so rows don't depend on them.

Counting needs no shards of its own, so it runs in as few tasks as can share the work. A task sends a
phrase once however many shards it holds, as long as its counts fit ``HELD``; beyond that the rarer
half goes on. So rows sent grow with the marked phrases, not with these times the shards.

A shard is a bounded number of words, so as the corpus grows the local support falls to 1: then the
first scan sends every phrase of a shard once, and the union of the counts is exact by itself. Small
corpora are read in fewer partitions, so that the local support stays above 2. Local supports are
planned by partition; one that holds other texts than planned, or more than a shard, takes 1 for the
rest, and rows stay the same.

Defined results: NULL texts are empty; a NULL language is ``und``. Repeated rows count each. Equal
scores are ordered by count, then by the UTF-8 bytes of the phrase. A text is never cut: one longer
than a shard is a shard of its own. Only the text and the language are read; other columns,
whatever their names, aren't touched. Empty tables give no rows. At most ``PLANNED`` local supports
above 1 are planned, the largest parts of languages first; others are 1, with the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm.tables import whole_texts, written
from tagloom.session import small_side

LONGEST = 4
SHARD_WORDS, COUNT_WORDS = 10_000_000, 3_000_000
SLICE_BYTES, CACHED_BYTES = 1 << 20, 1 << 18
PLANNED = 100_000
GROUP_PHRASES = 2_000_000  # of all shards, in a bucket of hashes
BIT_POWER = 26  # bits of the table of marked phrases: 8 MB
_AT_ONCE = 1 << 19
HELD = 2_000_000  # counts that a task adds up before it sends the rarer ones
TASK_BYTES = 1 << 30  # of text in a counting task, where there are more than the cores take at once
UNKNOWN = "und"

# What ends a piece, and what parts words within it.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_TABLE = bytearray(range(256))  # capitals become small, every end one of two bytes
_TABLE[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
for _byte in WORD_ENDS:
    _TABLE[_byte] = 0x20
for _byte in PIECE_ENDS:
    _TABLE[_byte] = 0x0A
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class _Cut:
    """Words of some texts: their bytes one after the other, lengths, whether they open a piece,
    and the text they are of."""

    letters: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    text: np.ndarray


def _cut(raw: np.ndarray, begins: np.ndarray) -> _Cut:
    """Cut texts that lie one after the other and begin at ``begins``."""
    byte = np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8)
    piece_end = byte == 0x0A
    inside = ~(piece_end | (byte == 0x20))
    opens = np.zeros(len(byte), bool)
    opens[begins] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | opens[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | opens[1:]
    at = np.flatnonzero(first)
    pieces = np.cumsum(piece_end | opens, dtype=np.int32)[at]
    starts = np.ones(len(at), bool)
    starts[1:] = pieces[1:] != pieces[:-1]
    text = np.cumsum(opens, dtype=np.int32)[at] - 1
    return _Cut(byte[inside], np.flatnonzero(last) + 1 - at, starts, text)


class Words:
    """The words of one language as numbers.

    ``ids`` are the words in order, ``starts`` tells which of them open a piece.
    """

    def __init__(self, lang: str):
        self.lang = lang
        self.n = 0
        self.words = pa.array([], pa.large_binary())  # by number, once joined
        self._ids: list[np.ndarray] = []
        self._starts: list[np.ndarray] = []
        self._named: list[pa.Array] = []
        self._size = 0

    def add(self, coded: np.ndarray, words: pa.Array, starts: np.ndarray) -> None:
        """Words as places in ``words``."""
        place, which = pd.factorize(coded)
        self._ids.append(place.astype(np.int32) + np.int32(self._size))
        self._named.append(words.take(pa.array(which)))
        self._starts.append(starts)
        self._size += len(which)
        self.n += len(coded)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and starts, handed over; from here on a word has one number."""
        starts = np.concatenate([np.zeros(0, bool), *self._starts])
        self._starts = []
        ids = np.empty(self.n, np.int32)
        if self.n:
            coded = pa.concat_arrays(self._named).dictionary_encode()
            self.words, number = coded.dictionary, coded.indices.to_numpy()
            at = 0
            for i, part in enumerate(self._ids):
                ids[at : at + len(part)] = number[part]
                at, self._ids[i] = at + len(part), None
        self._named = []
        return ids, starts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every numbered word and its language."""
        seed = xxhash.xxh3_64_intdigest(self.lang)
        found = np.empty(len(self.words), np.uint64)
        for at in range(0, len(found), 1 << 16):
            some = self.words.slice(at, 1 << 16).to_pylist()
            found[at : at + len(some)] = [xxhash.xxh3_64_intdigest(word, seed) for word in some]
        return found


class Shard:
    """Texts read so far, by language."""

    def __init__(self):
        self.words = 0
        self.languages: dict[str, Words] = {}

    def add(self, texts: pa.Array, languages: pa.Array) -> None:
        """Texts and languages without NULLs."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lang = languages.dictionary_encode()
        code = lang.indices.to_numpy()
        of = [self.languages.setdefault(x, Words(x)) for x in lang.dictionary.to_pylist()]
        begins = np.diff(offsets) > 0
        parts = []
        # Some texts at a time, so that what a byte needs stays in the processor's cache.
        reach = offsets[:-1] // CACHED_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(reach)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:]):
            parts.append(_cut(raw[offsets[lo] : offsets[hi]], offsets[lo:hi][begins[lo:hi]] - offsets[lo]))
            parts[-1].text = np.flatnonzero(begins[lo:hi])[parts[-1].text] + lo
        bounds = np.zeros(sum(len(p.lengths) for p in parts) + 1, np.int64)
        n = len(bounds) - 1
        if not n:
            return
        np.cumsum(np.concatenate([p.lengths for p in parts]), out=bounds[1:])
        letters = np.concatenate([p.letters for p in parts])
        coded = pa.Array.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]
        ).dictionary_encode()
        indices = coded.indices.to_numpy()
        starts = np.concatenate([p.starts for p in parts])
        mine = code[np.concatenate([p.text for p in parts])].astype(np.int16 if len(of) < 2**15 else np.int32)
        order = np.argsort(mine, kind="stable")
        stop = 0
        for words, size in zip(of, np.bincount(mine, minlength=len(of)).tolist()):
            some, stop = order[stop : stop + size], stop + size
            if size:
                words.add(indices[some], coded.dictionary, starts[some])
        self.words += n


def _mixed(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the word after it."""
    value = (phrase ^ (phrase >> np.uint64(29))) * _MIX[0] + word * _MIX[1]
    return value ^ (value >> np.uint64(32))


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """The texts of a task in runs of about ``most`` words; columns are text and language."""
    shard = Shard()
    free = pa.default_memory_pool().release_unused  # a worker is used again and again
    free()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        reach = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(reach)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                some = batch.slice(start, stop - start)
                shard.add(some.column(0).fill_null(""), some.column(1).fill_null(UNKNOWN))
            if shard.words >= most:
                yield shard
                shard = Shard()
                free()
    if shard.languages:
        yield shard


def _often(values: np.ndarray, support: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values found ``support`` times or more, in order, and their counts; a quarter at a time."""
    top = (values >> np.uint64(62)).astype(np.uint8)
    for quarter in range(4):
        some = np.sort(values[top == quarter])
        ends = np.append(some[1:] != some[:-1], True)[: len(some)]
        last = np.flatnonzero(ends)
        times = np.diff(last, prepend=-1)
        kept = times >= support
        yield some[last[kept]], times[kept]


def _longer(places, of, starts, ids, hashes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``n`` words where two of one word less follow each other in one piece.

    Works in place, some phrases at a time: a result never lies behind what it is made of.
    """
    size = 0
    for at in range(0, len(places), _AT_ONCE):
        here = places[at : at + _AT_ONCE + 1]
        both = here[1:] - here[:-1] == 1
        first = here[:-1][both]
        both[both] = ~starts[first + (n - 1)]
        first = here[:-1][both]
        made = _mixed(of[at : at + len(both)][both], hashes[ids[first + (n - 1)]])
        places[size : size + len(made)], of[size : size + len(made)] = first, made
        size += len(made)
    return places[:size], of[:size]


def _only(places, of, names) -> tuple[np.ndarray, np.ndarray]:
    """In place as well: phrases whose hash is one of ``names``, which are in order."""
    size = 0
    for at in range(0, len(places), _AT_ONCE):
        some = of[at : at + _AT_ONCE]
        kept = names[np.minimum(np.searchsorted(names, some), len(names) - 1)] == some
        n = int(kept.sum())
        places[size : size + n], of[size : size + n] = places[at : at + _AT_ONCE][kept], some[kept]
        size += n
    return places[:size], of[:size]


def frequent_here(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, support: int, longest: int):
    """``(hash, count)`` arrays of the frequent phrases, level by level; words come first."""
    counts = np.bincount(ids, minlength=len(hashes))
    often = np.flatnonzero(counts >= support)
    order = often[np.argsort(hashes[often])]
    yield hashes[order], counts[order]
    good = counts >= support
    steps = range(0, len(ids), _AT_ONCE)
    places = [np.flatnonzero(good[ids[at : at + _AT_ONCE]]).astype(np.int32) + np.int32(at) for at in steps]
    places = np.concatenate([np.zeros(0, np.int32), *places])
    of = hashes[ids[places]]
    for n in range(2, longest + 1):
        places, of = _longer(places, of, starts, ids, hashes, n)
        frequent = []
        for names, times in _often(of, support):
            yield names, times
            if support > 1 and n < longest:
                frequent.append(names)
        if frequent:
            names = np.concatenate(frequent)
            places, of = _only(places, of, names) if len(names) else (places[:0], of[:0])


def _pack(names: np.ndarray, gains: np.ndarray, bits: int) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Hashes in order and numbers as one value for each bucket: the bucket is the hash's first
    ``bits`` bits, of the rest 40 are kept."""
    bucket = (names >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(names), np.int32)
    rest = np.ascontiguousarray(names << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    cuts = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    packed = []
    for lo, hi in zip(cuts, cuts[1:]):
        some = gains[lo:hi]
        kind = np.uint8 if some.max() < 256 else np.int64
        packed.append(rest[lo:hi].tobytes() + some.astype(kind).tobytes())
    return bucket[cuts[:-1]], np.diff(cuts), packed


def _unpack(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    full = np.zeros((n, 8), np.uint8)
    full[:, :5] = np.frombuffer(value, np.uint8, 5 * n).reshape(n, 5)
    kind = np.uint8 if len(value) == 6 * n else np.int64
    return full.view(">u8").ravel().astype(np.uint64), np.frombuffer(value, kind, n, 5 * n).astype(np.int64)


def _mine(plan, support: int, longest: int, most: int, bits: int):
    """Locally frequent phrases in buckets of hashes, with what each count has over the shard's limit."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, shard in enumerate(_shards(batches, most)):
            for lang, words in shard.languages.items():
                ids, starts = words.joined()
                if not len(ids):
                    continue
                # A planned limit counts once: what else the partition holds is mined at 1.
                local = plan.value.get((part, lang), 1) if number == 0 else 1
                for names, times in frequent_here(ids, starts, words.hashes(), local, longest):
                    for at in range(0, len(names), _AT_ONCE):
                        gains = times[at : at + _AT_ONCE] - (local - 1)
                        for some in (gains < 256, gains >= 256):  # most need a byte
                            buckets, sizes, packed = _pack(names[at : at + _AT_ONCE][some], gains[some], bits)
                            columns = [
                                pa.array([lang] * len(packed), pa.string()),
                                pa.array(buckets, pa.int32()),
                                pa.array(sizes, pa.int32()),
                                pa.array(packed, pa.binary()),
                            ]
                            yield pa.RecordBatch.from_arrays(
                                columns, names=["lang", "bucket", "n", "packed"]
                            )

    return mine


def _unite(left_out, support: int, bits: int):
    """The bits of a bucket's phrases that may be frequent, as words of the bit table."""

    def unite(group: pa.Table) -> pa.Table:
        found = np.zeros(0, np.uint64)
        if group.num_rows:
            lang, bucket = group.column("lang")[0].as_py(), group.column("bucket")[0].as_py()
            parts = [
                _unpack(value, n)
                for value, n in zip(group.column("packed").to_pylist(), group.column("n").to_pylist())
            ]
            names, gains = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(names)
            names, gains = names[order], gains[order]
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            kept = np.add.reduceat(gains, first) + left_out.value.get(lang, 0) >= support
            found = names[first][kept]
            if bits:
                found = (found >> np.uint64(bits)) | np.uint64(bucket << (64 - bits))
        at = found >> np.uint64(64 - BIT_POWER)
        words, place = np.unique(at >> np.uint64(6), return_inverse=True)
        bit = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(bit, place, np.uint64(1) << (at & np.uint64(63)))
        return pa.table({"word": words.astype(np.int32), "bits": bit.view(np.int64)})

    return unite


def _halves(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rarer half of counted phrases, equals included, and the others."""
    counts = table.column("a").to_numpy()
    rare = counts <= np.median(counts)
    return table.filter(pa.array(rare)), table.filter(pa.array(~rare))


def _count(marked, longest: int, most: int):
    """Exact counts of the marked phrases of a task, as words."""

    def is_marked(hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - BIT_POWER)
        word = marked.value[(at >> np.uint64(6)).astype(np.int64)]
        return (word >> (at & np.uint64(63))) & np.uint64(1) != 0

    def levels(words: Words) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of one word, two words ... and their counts."""
        ids, starts = words.joined()
        hashes = words.hashes()
        names = words.words.cast(pa.binary()).cast(pa.string())
        found = is_marked(hashes)
        rank = np.cumsum(found) - 1  # of each word among the marked ones
        phrases = names.filter(pa.array(found))
        yield phrases, np.bincount(ids, minlength=len(hashes))[found]
        places = np.flatnonzero(found[ids]).astype(np.int32)
        rank, of = rank[ids[places]], hashes[ids[places]]
        for level in range(2, longest + 1):
            both = np.append(np.diff(places) == 1, False)[: len(places)]
            both[both] = ~starts[places[both] + (level - 1)]
            after = _mixed(of[both], hashes[ids[places[both] + (level - 1)]])
            kept = is_marked(after)
            both[both] = kept
            places, rank, of = places[both], rank[both], after[kept]
            if not len(places):
                return
            # The phrase before its last word, and that word: exact, whatever their hashes are.
            rank, pairs = pd.factorize(rank * len(hashes) + ids[places + (level - 1)])
            before, last = pa.array(pairs // len(hashes)), pa.array(pairs % len(hashes))
            phrases = pc.binary_join_element_wise(phrases.take(before), names.take(last), " ")
            yield phrases, np.bincount(rank, minlength=len(pairs))

    def rows(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(n), pa.string()), phrases, pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])

    def added(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).group_by(["lang", "phrase"]).aggregate([("a", "sum")])
        return table.rename_columns(["lang", "phrase", "a"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, most):
            for lang, words in shard.languages.items():
                yield rows(lang, pa.nulls(1, pa.string()), np.array([words.n]))  # all its words
                for phrases, n in levels(words):
                    yield rows(lang, phrases, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for some in found(batches):
            held.append(some)
            n += some.num_rows
            if n > HELD:  # what repeats is added up; the rarer half of what is left goes on
                table = added(held)
                if 4 * table.num_rows > 3 * HELD:
                    rare, table = _halves(table)
                    yield from rare.to_batches(1 << 16)
                held, n = table.to_batches(), table.num_rows
        if held:
            yield from added(held).to_batches(1 << 16)

    return count


def _marked(rows: DataFrame) -> np.ndarray:
    """The bit table: at most ``2 ** BIT_POWER / 64`` numbers reach the driver."""
    got = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (BIT_POWER - 6), np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint64)


def frequent_phrases(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    support: int = 30,
    longest: int = LONGEST,
    shard_words: int = SHARD_WORDS,
    count_words: int = COUNT_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, a`` of all phrases of up to ``longest`` words that occur ``support`` times,
    and ``lang, n``: all words of a language."""
    spark = docs.sparkSession
    whole_texts(spark)
    read = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
    )
    total = read.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    # Few and large shards keep the local support up; but no fewer than can share the work.
    cores = spark.sparkContext.defaultParallelism
    partitions = max(math.ceil(total / (6 * shard_words)), min(cores, support // 3), 1)
    parts = read.coalesce(partitions)
    plan = _plan(parts, support)
    left_out: dict[str, int] = {}
    for (_, of), local in plan.items():
        left_out[of] = left_out.get(of, 0) + local - 1
    bits = min(24, max(0, math.ceil(math.log2(max(1, total / 2 / GROUP_PHRASES)))))
    share = spark.sparkContext.broadcast
    mined = parts.mapInArrow(
        _mine(share(plan), support, longest, shard_words, bits),
        "lang string, bucket int, n int, packed binary",
    )
    united = mined.groupBy("lang", "bucket").applyInArrow(
        _unite(share(left_out), support, bits), "word int, bits long"
    )
    marked = share(_marked(united))
    tasks = min(partitions, max(cores, math.ceil(total / TASK_BYTES)))
    counted = read.coalesce(tasks).mapInArrow(
        _count(marked, longest, count_words), "lang string, phrase string, a long"
    )
    counts = written(
        counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(
            (F.col("a") >= support) | F.col("phrase").isNull()
        ),
        "frequent",
    )
    languages = counts.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    return counts.where(F.col("phrase").isNotNull()), small_side(languages)


def _plan(parts: DataFrame, support: int) -> dict[tuple[int, str], int]:
    """Local supports above 1 by partition and language.

    Partitions with more than one in ``support`` of a language's bytes have one, so there are less
    than ``support`` for each language.
    """
    sizes = parts.groupBy(F.spark_partition_id().alias("part"), "lang").agg(
        F.sum(F.octet_length("text").cast("long")).alias("bytes")
    )
    sizes = written(sizes, "shard-sizes")
    whole = sizes.groupBy("lang").agg(F.sum("bytes").alias("whole"))
    large = sizes.join(whole, "lang").where(
        F.lit(support).cast("decimal(10,0)") * F.col("bytes") > F.col("whole")
    )
    rows = large.orderBy(F.desc("bytes"), "lang", "part").limit(PLANNED).collect()
    return {(r["part"], r["lang"]): -(-support * r["bytes"] // r["whole"]) for r in rows}


def _exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    *,
    top: int = 2000,
    scale: int = 2_000_000,
    covered: tuple[int, int] = (80, 100),
    **settings,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    The score of a cut is ``floor(scale * a / (l + r))``; the lowest cut counts, the earliest of
    equals. A phrase goes if a longer one that holds it occurs ``covered`` (80 of 100) as often.
    """
    frequent, languages = frequent_phrases(docs, **settings)
    words = F.split("phrase", " ")
    split = frequent.select("lang", "phrase", "a", words.alias("words")).where(F.size("words") > 1)
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = split.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        part(F.lit(1), F.col("k")).alias("head"),
        part(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"),
    )
    counts = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = (
        cuts.join(counts("head", "l"), ["lang", "head"])
        .join(counts("tail", "r"), ["lang", "tail"])
        .withColumns({"x": F.lit(scale).cast("decimal(10,0)") * _exact("a"), "y": _exact("l") + _exact("r")})
        .withColumn("score", F.expr("x div y"))
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # Each shorter phrase inside a longer one, with the highest count of any that holds it.
    size = F.size("words")
    lengths = F.sequence(F.lit(2), size - 1)
    held = (
        split.where(size > 2)
        .select("lang", "words", "a", F.explode(lengths).alias("m"))
        .select(
            "lang",
            "a",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), size - F.col("m") + 1),
                    lambda i: F.array_join(F.slice("words", i, F.col("m")), " "),
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    drop = F.coalesce(
        F.lit(covered[1]) * _exact("longer") >= F.lit(covered[0]) * _exact("a"), F.lit(False)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        scored.join(held, ["lang", "phrase"], "left")
        .where(~drop)
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .join(languages.select("lang", "n"), "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
