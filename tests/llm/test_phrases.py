"""Collocations: brute force over shards of every size, edge texts, full bit tables."""

import re
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import phrases


def brute(rows, support=30, top=2000):
    out, n, f = [], Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {key: a for key, a in f.items() if a >= support}
    for lang in n:
        mine = []
        for (of, p), a in often.items():
            if of != lang or len(p) < 2:
                continue
            holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(o == lang and len(q) > len(p) and 100 * b >= 80 * a and holds(q) for (o, q), b in often.items()):
                continue
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            mine.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(spark, rows, parts=3, **settings):
    shape = "text string, lang string, phrase int, hash int, words string, a int"
    docs = spark.createDataFrame([(t, g, 1, 2, "x", 3) for t, g in rows], shape).repartition(parts)
    return sorted(tuple(r) for r in phrases.collocations(docs, **settings).collect())


def texts(seed, n=400):
    rnd = np.random.default_rng(seed)
    words = ["The", "red", "fox", "über", "a", "b", "c", "x-y", "Ärger", "日本", "\x00"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?!", " \xa0 "]
    rows = []
    for _ in range(n):
        size = int(rnd.integers(0, 40))
        pick = lambda of: of[int(rnd.integers(len(of)) * rnd.random())]
        rows.append(("".join(pick(words) + pick(ends) for _ in range(size)), ["en", "de", None][int(rnd.integers(3))]))
    rows += [(None, "en"), ("", None), (" \t.,", "xx"), ("one", "one")] + [("New York City hall of fame", "en")] * 120
    return rows


@pytest.mark.parametrize(
    ("seed", "settings"),
    [
        (1, {}),
        (2, {"support": 6, "top": 15, "shard_words": 60, "count_words": 50}),  # local support 1
        (3, {"support": 40, "shard_words": 900, "count_words": 100}),
    ],
)
def test_equals_brute_force(spark, seed, settings):
    rows = texts(seed)
    assert found(spark, rows, **settings) == brute(
        rows, **{k: v for k, v in settings.items() if k in ("support", "top")}
    )


@pytest.mark.parametrize("held", [0, 40, 2000])
def test_counts_added_up_in_parts(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD", held)
    rows = texts(5, 200)
    assert found(spark, rows, parts=2, support=6, count_words=150) == brute(rows, 6)


def test_counts_sent_do_not_grow_with_the_shards(spark, monkeypatch):
    """Five times the texts in five times the shards, all phrases marked: each task sends a phrase once."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(phrases, "_marked", lambda rows: np.full(1 << (phrases.BIT_POWER - 6), 2**64 - 1, np.uint64))
    counting, rows = phrases._count, texts(6, 30)[:34] * 40

    def sent(copies):
        seen = spark.sparkContext.accumulator(0)

        def counted(*settings):
            count = counting(*settings)

            def noted(batches):
                for batch in count(batches):
                    seen.add(batch.num_rows)
                    yield batch

            return noted

        monkeypatch.setattr(phrases, "_count", counted)
        size = sum(len((text or "").encode()) for text, _ in rows) // (6 * cores)
        got = found(spark, rows * copies, parts=cores * copies, support=30 * copies, shard_words=size)
        assert [r[2] for r in got] == [r[2] for r in brute(rows * copies, 30 * copies)]
        return seen.value

    assert sent(5) < 1.2 * sent(1)


def test_counts_of_any_size_are_halved():
    table = lambda counts: phrases.pa.table({"phrase": [str(a) for a in counts], "a": counts})
    for counts in ([1, 1, 2, 2**24 + 3, 2**24 + 4, 2**62], [5, 5, 5], [2**40]):
        rare, others = phrases._halves(table(counts))
        assert 2 * rare.num_rows >= len(counts) and rare.num_rows + others.num_rows == len(counts)
        assert sorted(rare["a"].to_pylist() + others["a"].to_pylist()) == counts


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_marked", lambda rows: np.full(1 << (phrases.BIT_POWER - 6), 2**64 - 1, np.uint64))
    rows = texts(4, 100)
    assert found(spark, rows, support=5) == brute(rows, 5)


def test_long_texts_and_repeats(spark):
    """Runs of one word overlap; a text of many shards' size; pieces longer than a slice."""
    rows = [("ha " * 50_000, "en"), ("ho" * 200_000 + " ha, ha", "en"), ("go on. " * 40_000, "de")] * 2
    assert found(spark, rows, shard_words=1000) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == [] == found(spark, [(None, None), ("a b", "en")])


def test_local_mining_is_complete():
    rnd = np.random.default_rng(8)
    ids = rnd.integers(0, 4, 3000)
    starts = rnd.random(3000) < 0.1
    starts[0] = True
    hashes = rnd.integers(0, 2**63, 4).astype(np.uint64)
    levels = list(phrases.frequent_here(ids, starts, hashes, 12, 4))
    levels = [levels[:1], levels[1:5], levels[5:9], levels[9:]]  # words at once, others by quarters
    for n, parts in enumerate(levels, 1):
        times = np.concatenate([t for _, t in parts])
        want = Counter(
            tuple(ids[i : i + n]) for i in range(len(ids) - n + 1) if not starts[i + 1 : i + n].any()
        )
        assert sorted(times.tolist()) == sorted(v for v in want.values() if v >= 12)
        names = np.concatenate([x for x, _ in parts])
        assert len(names) and (names[1:] > names[:-1]).all()


@pytest.mark.parametrize("bits", [0, 3, 24])
def test_packed_runs_return(bits):
    rnd = np.random.default_rng(9)
    names = np.unique(rnd.integers(0, 2**64, 500, np.uint64))
    gains = rnd.integers(1, 400, len(names))
    buckets, sizes, packed = phrases._pack(names, gains, bits)
    got = [phrases._unpack(value, n) for value, n in zip(packed, sizes)]
    back = np.concatenate([(x >> np.uint64(bits)) | np.uint64(int(b) << (64 - bits) if bits else 0) for b, (x, _) in zip(buckets, got)])
    kept = np.uint64(2**64 - 2 ** max(0, 24 - bits))
    assert (back & kept == names & kept).all() and (np.concatenate([g for _, g in got]) == gains).all()
