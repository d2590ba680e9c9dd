"""Exact top-k: brute force, blocks, ties, copies, odd vectors, no work left out by the bounds."""

import math

import numpy as np
import pytest

from tagloom.llm import topk


def brute(rows, asked, k=5, scale=256):
    """(query id, rank, id, score) with NULL ids last among ties."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(v)]
    out = []
    for q, v in ((i, [math.floor(scale * x) for x in v]) for i, v in asked if ok(v)):
        scores = [
            (-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i)
            for i, w in whole
            if i != q and len(w) == len(v)
        ]
        out += [(q, n, s[3], -s[0]) for n, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, asked, kind="float", **settings):
    shape = f"vec_id long, embedding array<{kind}>, far int, cell string, numbers int, row int, score int"
    frame = lambda some: spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in some], shape)
    got = topk.top_k(frame(asked), frame(rows).repartition(3), **settings).collect()
    return sorted((tuple(r) for r in got), key=repr)


def vectors(seed, n=400, dim=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((6, dim))
    out = [(centres[rnd.integers(6)] + 0.2 * rnd.standard_normal(dim)) for _ in range(n)]
    out += [out[0]] * 150  # a third are copies: ties at the border
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [1.0, 2.0], [3.0, -1.0]]
    odd += [[float("-inf")] + [1.0] * (dim - 1), []]
    return rows + [(10_000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"pivots": 5, "sample": 20, "block": (16, 7)})])
def test_equals_brute_force(spark, seed, settings):
    rows = vectors(seed)
    asked = [r for r in rows if r[0] % 9 == 0] + rows[-9:]
    assert found(spark, rows, asked, **settings) == brute(rows, asked)


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(i, [1.0, 1.0]) for i in (7, 3, 3, 9, None, None, 5)] + [(1, [-5.0, 0.0])]
    asked = [(3, [1.0, 1.0]), (None, [2.0, 0.0]), (None, [2.0, 0.0])]
    assert found(spark, rows, asked, k=3) == brute(rows, asked, k=3)
    assert found(spark, rows[:2], asked, k=3) == brute(rows[:2], asked, k=3)


def test_large_components_are_exact(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) * 2.0**21 for x in rnd.standard_normal(3)]) for i in range(60)]
    assert found(spark, rows, rows[:9], "double", pivots=4) == brute(rows, rows[:9])


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [(1, [1.0])]) == [] == found(spark, [(1, [1.0])], [])


def test_bounds_hold_and_spare_work():
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((20, 8)) * 300
    rows = np.floor(centres[rnd.integers(20, size=2000)] + 20 * rnd.standard_normal((2000, 8))).astype(np.int64)
    norm = float(np.linalg.norm(rows.astype(float), axis=1).max())
    table = topk.PivotTable(topk.farthest_first(rows, norm, 32), rows[:200], np.arange(200), norm)
    far, asked = table.of_candidates(rows), rows[::40]
    low = np.abs(table.of_queries(asked)[:, None] - far[None]).max(axis=2)
    high = table.highest(np.linalg.norm(asked.astype(float), axis=1)[:, None], low)
    scores = asked @ rows.T
    assert (high >= scores).all()
    least = np.sort(scores, axis=1)[:, -5]
    assert (high >= least[:, None]).mean() < 0.5  # what has to be evaluated at all
