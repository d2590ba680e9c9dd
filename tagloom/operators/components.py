"""Connected components by alternating large-star and small-star steps.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: "Connected Components in MapReduce and
Beyond", SoCC 2014. Each step is one minimum per node and one join, so no neighbourhood is ever
collected; the edge list shrinks to stars around the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.session import cut_lineage, small_side


def _downhill(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one, loops dropped."""
    return (
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour.

    All edges given and returned lead from the larger to the smaller node.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter("v > u")
        .join(smallest, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v")))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(src, dst)``.

    The component is named by its smallest node. Rounds run until the edge list stays the same.
    """
    current = cut_lineage(_downhill(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    before = _fingerprint(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        current = cut_lineage(_downhill(_small_star(_large_star(current))))
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labelling ``(node, component)`` after new undirected edges ``(src, dst)`` came in.

    Equals ``connected_components`` of the old and new edges together. The new edges are contracted to
    edges between the labels of their ends, and only those go through the rounds, so that the work grows
    with the new edges, whatever the size of the old graph. ``labels`` should be a written table, with one
    row a node: it is read three times, for the labels of either end and for the result, and isn't
    shuffled as long as the new edges are few enough to broadcast.

    A component is named by its smallest node, old or new. Loops and edges with a NULL end are none.
    """
    new = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    ends = new.select(F.col("src").alias("node")).unionByName(new.select(F.col("dst").alias("node"))).distinct()
    # Labels of the ends; an end without one is a new node and its own label.
    old = labels.select("node", "component").join(small_side(ends), "node")
    known = cut_lineage(
        ends.join(old, "node", "left").select(
            "node", F.coalesce("component", "node").alias("label"), F.col("component").isNull().alias("fresh")
        )
    )
    label_of = small_side(known)
    quotient = (
        new.join(label_of.select(F.col("node").alias("src"), F.col("label").alias("a")), "src")
        .join(label_of.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    merged = cut_lineage(
        connected_components(quotient).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    )
    fresh = known.filter("fresh").select("node", F.col("label").alias("component"))
    every = labels.select("node", "component").unionByName(fresh)
    return every.join(small_side(merged), "component", "left").select(
        "node", F.coalesce("merged", "component").alias("component")
    )


def group_by_components(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Mapping of every tag to the smallest tag of its component; others map to themselves."""
    components = connected_components(edges).select(
        F.col("node").alias("tag"), F.col("component").alias("canonical")
    )
    return tags.join(components, "tag", "left").select(
        "tag", F.coalesce("canonical", "tag").alias("canonical")
    )
