"""Centroid clustering: plain rounds in Python integers, the tree against a full search, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from tagloom.llm import clusters


def plain(rows, k=8, rounds=10, dim=4, scale=1024):
    """Sorted (id, cluster, distance, cluster inertia, inertia, centroid)."""
    ok = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(v)]
    mark = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for i, v in sorted(kept, key=lambda r: (r[0] is None, mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in set(of):
            mine = [v for (_, v), m in zip(kept, of) if m == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [near(v) for _, v in kept]
    total = lambda n: sum(d for d, m in ends if m == n)
    rows = [
        (i, n, d, total(n), sum(d for d, _ in ends), tuple(centroids[n])) for (i, _), (d, n) in zip(kept, ends)
    ]
    return sorted(rows, key=repr)


def found(spark, rows, kind="float", **settings):
    shape = f"vec_id long, embedding array<{kind}>, cluster string, distance int, numbers int, id string"
    table = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], shape).repartition(3)
    got = clusters.cluster_vectors(table, **{"dim": 4, **settings}).collect()
    return sorted(((*tuple(r)[:5], tuple(r["centroid"])) for r in got), key=repr)


def vectors(seed, n=500):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rnd.standard_normal(4)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]
    odd = [None, [], [1.0, 2.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0]]
    return rows + [(5000 + i, v) for i, v in enumerate(odd)] + [(None, [0.5] * 4), (7, [0.0] * 4), (7, [0.0] * 4)]


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"rounds": 2}), (3, {"rounds": 0})])
def test_equals_plain_rounds(spark, seed, settings):
    rows = vectors(seed)
    assert found(spark, rows, **settings) == plain(rows, **settings)


def test_few_vectors_and_ties(spark):
    rows = [(1, [0.0] * 4), (2, [0.0] * 4), (3, [0.0, 0.0, 0.0, 2.0]), (4, [0.0, 0.0, 0.0, 1.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, clusters=2, rounds=0) == plain(rows, k=2, rounds=0)


def test_large_components_are_exact(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, [float(x) * 2.0**16 for x in rnd.standard_normal(4)]) for i in range(100)]
    assert found(spark, rows, "double") == plain(rows)


def test_beyond_64_bits_is_cut(spark):
    rows = [(i, [s * 1e300, 0.0, 0.0, float(i)]) for i, s in enumerate((1, -1, 1, -1, 0))]
    got = found(spark, rows, "double", clusters=2, rounds=3)
    assert len(got) == 5 and max(r[2] for r in got) == clusters.MOST and {r[4] for r in got} == {clusters.MOST}


def test_empty_table(spark):
    assert found(spark, []) == [] == found(spark, [(1, None)])


def test_tree_meets_every_tie():
    rnd = np.random.default_rng(7)
    for _ in range(30):
        points = rnd.integers(-3, 4, (rnd.integers(1, 20), 3))
        tree = clusters.VantageTree(points.tolist())
        rows = rnd.integers(-4, 5, (200, 3))
        far = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
        number, distance = tree.nearest(rows)
        assert (number == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
