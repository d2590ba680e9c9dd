"""Limits, splits and shards over an explicit order, without ever numbering all rows.

A prefix or a contiguous shard is decided by the order values at a few ranks. Those are found
with counting passes over one column; the split itself is then a plain row filter, so the data
is neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Counts that reach the driver per pass, of all ranks together.
BINS = 1 << 18


def head_limit(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows picked by a hash of their key: random, yet the same on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed))), key).limit(n)


def _counts_within(
    values: DataFrame, ranges: list[tuple[int, int]], bins: int
) -> dict[tuple[int, int], tuple[int, dict[int, int]]]:
    """Bin width and counts by bin for each of some disjoint ranges, in one pass."""
    bins = max(2, bins)
    place, part = F.lit(None).cast("int"), F.lit(None).cast("long")
    widths = [-(-(hi - lo + 1) // bins) for lo, hi in ranges]
    for k, (lo, hi) in enumerate(ranges):
        # A range of half the 64-bit numbers or more does not fit one; decimals hold it.
        value, unit = ("v", "L") if hi - lo < 2**63 else ("CAST(v AS DECIMAL(20,0))", "BD")
        inside = F.col("v").between(lo, hi)
        nr = F.expr(f"CAST(({value} - ({lo}{unit})) div {widths[k]}{unit} AS BIGINT)")
        place, part = F.when(inside, k).otherwise(place), F.when(inside, nr).otherwise(part)
    counted = (
        values.select(place.alias("range"), part.alias("bin"))
        .filter("range IS NOT NULL")
        .groupBy("range", "bin")
        .agg(F.count("*").alias("n"))
    )
    found: dict[tuple[int, int], tuple[int, dict[int, int]]] = {
        r: (w, {}) for r, w in zip(ranges, widths, strict=True)
    }
    for row in counted.collect():
        found[ranges[row["range"]]][1][row["bin"]] = row["n"]
    return found


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> list[int]:
    """The values of an integer column at 1-based ranks in ascending order.

    Each pass counts ``BINS`` equal ranges at most and keeps those that hold a rank. All ranks share
    the passes: twenty of them need five over one pruned column of 64-bit numbers, or fewer.
    """
    values = df.select(F.col(column).cast("long").alias("v")).filter("v IS NOT NULL")
    edge = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    # All ranks are refined together: a pass counts the open ranges of all of them.
    places = [(edge["lo"], edge["hi"], rank) for rank in ranks]
    while any(lo < hi for lo, hi, _ in places):
        ranges = sorted({(lo, hi) for lo, hi, _ in places if lo < hi})
        counts = _counts_within(values, ranges, BINS // len(ranges))
        places = [
            _narrowed(lo, hi, left, *counts[lo, hi]) if lo < hi else (lo, hi, left)
            for lo, hi, left in places
        ]
    return [lo for lo, _, _ in places]


def _narrowed(
    lo: int, hi: int, left: int, width: int, counts: dict[int, int]
) -> tuple[int, int, int]:
    """The bin of a range that holds a rank, and the rank within it."""
    for place in sorted(counts):
        if left <= counts[place]:
            break
        left -= counts[place]
    return lo + place * width, min(lo + (place + 1) * width - 1, hi), left


def prefix_split(df: DataFrame, key: str, eval_share: float = 0.2) -> DataFrame:
    """Adds ``split``: the first rows by ``key`` are ``train``, the last share ``eval``."""
    size = int((1 - eval_share) * df.count())
    if size == 0:
        return df.withColumn("split", F.lit("eval"))
    (last,) = values_at_ranks(df, key, [size])
    return df.withColumn("split", F.when(F.col(key) <= last, "train").otherwise("eval"))


def shard_assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds ``shard``: equal contiguous runs by ``key``, the last one takes the remainder."""
    chunk = df.count() // shards
    if chunk == 0:
        return df.withColumn("shard", F.lit(shards - 1))
    lasts = values_at_ranks(df, key, [chunk * i for i in range(1, shards)])
    passed: Column = F.lit(0)
    for last in lasts:
        passed = passed + (F.col(key) > last).cast("int")
    return df.withColumn("shard", passed)


def limit_per_group(df: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """The first ``n`` rows of each group, such as each input file.

    The rank limit is applied within tasks before the shuffle, so that a group of any size sends
    ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
