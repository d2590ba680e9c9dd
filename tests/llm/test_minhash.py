"""Near duplicates: brute force over full sets, edge cases, groups of copies, the estimator."""

import random
import re

import numpy as np
import pytest

from tagloom.llm import minhash


def shingles(text, words):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows, words, percent):
    """Smallest id of each row's component; rows are (id, text) with ids of their own."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    least = {}
    for i, (id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), id), id)
    return {id: (len(sets[i]), least[find(i)]) for i, (id, _) in enumerate(rows)}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    word = lambda: rnd.choice(vocabulary)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO  words", "É é", "é É"]
    shared = [word() for _ in range(13)]
    for _ in range(40):  # a common line in short texts
        texts.append(" ".join(shared + [word() for _ in range(rnd.randint(0, 8))]))
    for _ in range(12):  # chains of edits: neighbours are linked, ends are not
        words = [word() for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, 12)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = word()
    texts += [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts += texts[20:40] * 3  # copies
    texts.append(" ".join(word() for _ in range(40_000)))
    texts.append(texts[-1] + " tail")
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i * 3 + 1, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, words, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, words=words, percent=percent).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(
        rows, words, percent
    )


def test_links_away_from_the_centre_are_found(spark):
    """One band key for all: only the second comparison can link what the centre doesn't."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=3, percent=85, bands=12, rows=1).collect()
    want = brute(rows, 3, 85)
    assert {r["id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_null_and_repeated_ids(spark):
    rows = [
        (None, "a b c d", "x"),
        (None, "a b c d", "x"),
        (7, "a b c d", "y"),
        (7, "q r s t", "y"),
        (7, "q r s t", "y"),
        (None, "only null", "z"),
        (None, "only null", "z"),
        (None, "other null", "z"),
        (8, None, "n"),
        (8, None, "n"),
        (9, "", "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = minhash.near_duplicates(docs, words=3, percent=85).collect()
    ids = sorted((repr(r["id"]), repr(r["component_id"])) for r in got)
    assert ids == sorted(
        [("None", "7")] * 2 + [("7", "7")] * 3 + [("None", "None")] * 3 + [("8", "8")] * 2 + [("9", "9")]
    )
    kept = minhash.drop_near_duplicates(docs, words=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(
        map(
            repr,
            [
                (7, "a b c d", "y"),
                (7, "q r s t", "y"),
                (None, "only null", "z"),
                (None, "other null", "z"),
                (8, None, "n"),
                (8, None, "n"),
                (9, "", "e"),
            ],
        )
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.drop_near_duplicates(docs).count() == 0


def test_coordinates_estimate_similarity():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = ids[:2000], ids[500:2500]  # similarity 0.6
    same = minhash.signature(a, 2000) == minhash.signature(b, 2000)
    assert abs(same.mean() - 0.6) < 0.05
