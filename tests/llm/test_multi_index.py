"""Near vectors: brute force, recall of pairs at the threshold, blocks, odd vectors."""

import numpy as np
import pytest

from tagloom.llm import multi_index


def brute(rows, cosine=0.9):
    """(links, smallest id reachable) by id; rows are (id, vector) with ids of their own."""
    usable = [
        (i, np.array(v, np.float64))
        for i, v in rows
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    near = []
    for k, (i, a) in enumerate(usable):
        for j, b in usable[:k]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                near.append((i, j))
    while True:
        before = dict(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return {i: (links[i], label[i]) for i, _ in rows}


def vectors(seed, n=300, dim=16):
    rnd = np.random.default_rng(seed)
    out = [rnd.standard_normal(dim) for _ in range(n)]
    for k in range(0, 60, 3):  # close copies, copies and scaled copies
        out += [out[k] + 0.05 * rnd.standard_normal(dim), out[k].copy(), 3 * out[k]]
    centre = rnd.standard_normal(dim)
    out += [centre + 0.02 * rnd.standard_normal(dim) for _ in range(150)]  # one crowded spot
    walk = rnd.standard_normal(dim)
    for _ in range(25):  # a chain whose ends aren't linked
        out.append(walk / np.linalg.norm(walk))
        walk = out[-1] + 0.07 * rnd.standard_normal(dim)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rnd.permutation(len(out)), out)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0]]
    odd += [[None] + [1.0] * (dim - 1), [2.0, 4.0], [1.0, -2.0]]
    return rows + [(10_000 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize(("seed", "kind", "blocks"), [(1, "float", (4096, 16384)), (2, "double", (16, 40))])
def test_links_and_components(spark, seed, kind, blocks):
    rows = vectors(seed)
    table = spark.createDataFrame(
        [(i, v, -1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int"
    ).repartition(3)
    got = multi_index.near_vectors(table, recall=1.0, members=blocks[0], visitors=blocks[1]).collect()
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in got} == brute(rows)


def test_recall_of_the_hardest_pairs():
    """Pairs at the threshold itself: the share that meets in a visited cell."""
    rnd = np.random.default_rng(5)
    sample = rnd.standard_normal((1024, 32))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    book = multi_index.Codebooks(sample, 16, 0.9, 0.99)
    a = rnd.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rnd.standard_normal(a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(0.19) * noise
    cells = [book.cells(book.distances(x)) for x in (a, b)]
    meet = book.visits(a, cells[1]) | book.visits(b, cells[0])
    assert meet.mean() >= 0.97


def test_traversal_is_in_order_and_complete():
    rnd = np.random.default_rng(6)
    sample = rnd.standard_normal((256, 10))
    book = multi_index.Codebooks(sample, 8, 0.9, 0.9)
    for row in rnd.standard_normal((50, 10)):
        one, two = (d[0] for d in book.distances(row[None]))
        cells = book.traverse((one, two))
        cost = one[cells // 8] + two[cells % 8]
        assert (np.diff(cost) >= -1e-12).all() and cost[0] == one.min() + two.min()
        assert len(cells) == len(set(cells)) == (one[:, None] + two[None] <= cost[0] + book.slack + 1e-12).sum()


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [0.0, 1.0]), (None, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.near_vectors(table).collect()
    assert sorted((repr(r["id"]), r["n_links"], repr(r["component_id"])) for r in got) == sorted(
        [("None", 2, "5"), ("None", 2, "5"), ("5", 2, "5"), ("5", 0, "5"), ("None", 0, "None")]
    )


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.near_vectors(table).count() == 0
