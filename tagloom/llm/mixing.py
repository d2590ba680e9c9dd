"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target share of the mix. Its documents are dealt into blocks; the mix takes every
block as often as the target holds the whole source, and of the rest a permuted run of blocks. The
last, partly taken block gives the documents that fill the target best, and what room is left then
goes to documents of other blocks, or to further copies, until none fits. All block draws go
through a binary tree over the output shards: every node hands an exact number of draws, chosen
without replacement, to its left half, so that the sources' counts in every shard are a multivariate
hypergeometric draw. These counts are the shards' quotas; each source's permuted draws are cut into
disjoint runs by them, and a shard shuffles what it has drawn locally.

Documents meet only their own block's row: the job reads the documents, counts blocks, and joins the
small block table back. All randomness is hashes of the seed and names, so reruns agree.

Defined results: NULL text or a text without words has size 0; it is drawn as others are and adds
nothing. A NULL source is a source, the last one. Rows repeated as a whole are drawn together or
not at all. A source without words has target 0 and is not drawn. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.llm.tables import fingerprint, written
from tagloom.llm.words import word_count
from tagloom.session import small_side

MOST_REPEATS = 3
BLOCK_DOCS = 512
SHARD_WORDS = 4_000_000


def source_weights(sources: DataFrame) -> DataFrame:
    """``sources`` and ``weight``: 1, 2, 3 repeating by code point, NULL last."""
    # UTF-8 bytes sort by code point.
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, words, weight)`` and ``target``: shares of all words by weight.

    A target stops at ``most`` times its source's words, and what it leaves is shared again by
    weight. Sources reach their limits in the order of limit per weight, so running sums over that
    order tell at which level the shares settle.
    """
    limit = F.col("words") * most
    by_level = Window.orderBy(limit / F.col("weight"), "weight", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("words").over(whole)
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = total - F.coalesce(F.sum(limit).over(before), F.lit(0))
    # Were this source and all after it open, their common level would be:
    levels = sources.withColumn("level", left / open_weight)
    # The first level that its own source can take is the one; later ones are lower.
    settled = F.max(F.when(F.col("level") * F.col("weight") <= limit, F.col("level"))).over(whole)
    share = F.coalesce(settled * F.col("weight"), limit.cast("double"))
    return levels.withColumn("target", F.least(share, limit.cast("double"))).drop("level")


def _hash(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _prepared(docs: DataFrame, source: str, id: str, text: str) -> dict[str, Column]:
    return {
        "mix__source": F.col(source),
        "mix__size": word_count(F.col(text)),
        "mix__row": F.xxhash64(F.col(id).cast("string"), fingerprint(F.col(text))),
    }


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _blocks(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``(source, block, words, target, words of the source)`` of the dealt blocks."""
    dealt = rows.join(
        small_side(sources.select(F.col("source").alias("s"), "n_blocks")),
        _same_source("mix__source", "s"),
    )
    return (
        dealt.withColumn("block", _block_of(seed, F.col("mix__row"), F.col("n_blocks")))
        .groupBy("s", "block")
        .agg(F.sum("mix__size").alias("block_words"))
    )


def _block_of(seed: int, row: Column, n_blocks: Column) -> Column:
    return F.pmod(_hash(seed, F.lit("block"), row), n_blocks).cast("int")


def _split_tree(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(source, shard, quota)``: the draws, one row each, handed down a binary tree.

    A node over k shards hands its left half, of k // 2 shards, that share of its draws. Which ones
    it hands is a draw without replacement, so the counts by source are multivariate hypergeometric.
    """
    nodes = draws.withColumns({"low": F.lit(0), "width": F.lit(shards)})
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        node = Window.partitionBy("low", "width")
        order = node.orderBy(_hash(seed, F.lit(level), "source", "round", "block"), "source", "round", "block")
        half = F.floor(F.col("width") / 2).cast("int")
        left = F.floor(F.count("*").over(node) * half / F.col("width"))
        goes_left = F.row_number().over(order) <= left
        nodes = nodes.select(
            *draws.columns,
            "low",
            "width",
            F.when(F.col("width") > 1, goes_left).alias("is_left"),
            half.alias("half"),
        ).select(
            *draws.columns,
            F.when(F.col("is_left").isNull() | F.col("is_left"), F.col("low"))
            .otherwise(F.col("low") + F.col("half"))
            .alias("low"),
            F.when(F.col("is_left").isNull(), F.col("width"))
            .when(F.col("is_left"), F.col("half"))
            .otherwise(F.col("width") - F.col("half"))
            .alias("width"),
        )
    return nodes.groupBy("source", F.col("low").alias("shard")).agg(F.count("*").alias("quota"))


def _largest_first(room: Column) -> Column:
    """Of ``units`` (minus size, hash, row) in order each that still fits, and the room left."""
    start = F.struct(
        room.cast("double").alias("room"),
        F.array().cast("array<struct<row:bigint,size:bigint>>").alias("picked"),
    )
    return F.aggregate(
        "units",
        start,
        lambda acc, u: F.when(
            -u["col1"] <= acc["room"],
            F.struct(
                (acc["room"] + u["col1"]).alias("room"),
                F.concat(
                    acc["picked"],
                    F.array(F.struct(u["row"].alias("row"), (-u["col1"]).cast("bigint").alias("size"))),
                ).alias("picked"),
            ),
        ).otherwise(acc),
    )


class Mix:
    """The mix of a table: which documents it takes, how often, and to which shards.

    ``rows`` has every row of ``docs`` with three columns more: ``mix__source``, ``mix__size`` and
    ``mix__shards``, an array with the shard of every copy drawn.
    """

    def __init__(
        self,
        docs: DataFrame,
        *,
        id: str = "doc_id",
        text: str = "text",
        source: str = "source",
        shard_words: int = SHARD_WORDS,
        seed: int = 17,
        most: int = MOST_REPEATS,
        block_docs: int = BLOCK_DOCS,
    ):
        self.docs, self.seed = docs, seed
        prepared = _prepared(docs, source, id, text)
        # Texts are read for their sizes once; later steps see three numbers a row.
        slim = written(docs.select(*[c.alias(n) for n, c in prepared.items()]), "sizes")
        counted = slim.groupBy(F.col("mix__source").alias("source")).agg(
            F.sum("mix__size").alias("words"), F.count("*").alias("n_docs")
        )
        weighted = targets(source_weights(counted), most)
        self.sources = written(
            weighted.withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs).cast("int")), "sources"
        )
        total = self.sources.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
        self.shards = max(1, math.ceil(total / shard_words))
        plan = self._plan(slim, self.shards, seed)
        known = small_side(
            self.sources.select(
                F.col("source").alias("mix__s"), F.col("n_blocks").alias("mix__n_blocks")
            )
        )
        block = _block_of(seed, prepared["mix__row"], F.col("mix__n_blocks"))
        dealt = (
            docs.join(known, docs[source].eqNullSafe(F.col("mix__s")))
            .withColumns(prepared)
            .withColumn("mix__block", block)
        )
        more = self._more(slim, plan, self.shards, seed, most)
        drawn = dealt.join(
            small_side(plan.drop("left", "n_whole")),
            _same_source("mix__s", "mix__of") & (F.col("mix__block") == F.col("mix__nr")),
            "left",
        ).join(
            small_side(more),
            _same_source("mix__s", "more__of") & (F.col("mix__row") == F.col("more__row")),
            "left",
        )
        picked = F.array_contains("mix__picks", F.col("mix__row"))
        partly = F.when(picked, F.col("mix__part")).otherwise(F.array().cast("array<int>"))
        none = F.array().cast("array<int>")
        self.rows = drawn.withColumn(
            "mix__shards",
            F.concat(F.coalesce("mix__whole", none), F.coalesce(partly, none), F.coalesce("more__shards", none)),
        ).select(*docs.columns, "mix__source", "mix__size", "mix__row", "mix__shards")

    def _plan(self, slim: DataFrame, shards: int, seed: int) -> DataFrame:
        """One row per block: the shards of its whole draws, and of its part if it has one."""
        sources = self.sources.select(
            "source",
            F.col("target"),
            F.col("words"),
            F.coalesce(F.floor(F.try_divide("target", "words")), F.lit(0)).alias("epochs"),
        ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("words"))
        blocks = _blocks(slim, self.sources, seed)
        permuted = Window.partitionBy("s").orderBy(_hash(seed, F.lit("permute"), "s", "block"), "block")
        so_far = permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = (
            blocks.join(small_side(sources), _same_source("s", "source"))
            .withColumns({"end": F.sum("block_words").over(so_far), "at": F.row_number().over(permuted)})
            .withColumn("begin", F.col("end") - F.col("block_words"))
        )
        # Which of its draws is a block's last: whole, partial (the target ends inside), or none.
        taken = written(
            ranked.withColumns(
                {
                    "whole": F.col("epochs") + (F.col("end") <= F.col("rest")).cast("long"),
                    "part": (F.col("begin") < F.col("rest")) & (F.col("rest") < F.col("end")),
                }
            ).select("source", "block", "at", "whole", "part", (F.col("rest") - F.col("begin")).alias("room")),
            "blocks",
        )
        count = F.col("whole") + F.col("part").cast("long")
        draws = taken.filter(count > 0).select(
            "source", "block", "at", F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("round")
        )
        quotas = _split_tree(draws.select("source", "block", "round"), shards, seed)
        # Runs of each source's permuted draws, as long as the shards' quotas.
        by_shard = Window.partitionBy("source").orderBy("shard")
        upto = F.sum("quota").over(by_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        runs = quotas.withColumn("upto", upto).select(
            F.col("source").alias("q"),
            "shard",
            F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("nr"),
        )
        order = Window.partitionBy("source").orderBy("round", "at")
        placed = draws.withColumn("nr_", F.row_number().over(order)).join(
            runs, _same_source("source", "q") & (F.col("nr_") == F.col("nr"))
        )
        shards_of = placed.groupBy("source", "block").agg(
            F.sort_array(F.collect_list(F.struct("round", "shard"))).alias("placed")
        )
        picks = self._picks(slim, taken, seed)
        both = (
            taken.select(F.col("source").alias("mix__of"), F.col("block").alias("mix__nr"), "whole", "part")
            .join(shards_of, _same_source("mix__of", "source") & (F.col("mix__nr") == F.col("block")))
            .drop("source", "block")
            .join(picks, _same_source("mix__of", "p_source") & (F.col("mix__nr") == F.col("p_block")), "left")
        )
        in_order = F.transform("placed", lambda p: p["shard"])
        return written(
            both.select(
                "mix__of",
                "mix__nr",
                F.slice(in_order, F.lit(1), F.col("whole").cast("int")).alias("mix__whole"),
                F.when(F.col("part"), F.slice(in_order, F.col("whole").cast("int") + 1, F.lit(1))).alias("mix__part"),
                F.col("picks").alias("mix__picks"),
                F.col("whole").alias("n_whole"),
                "left",
            ),
            "plan",
        )

    def _more(self, slim: DataFrame, plan: DataFrame, shards: int, seed: int, most: int) -> DataFrame:
        """``(source, row, shards)`` of the copies that fill what the partly taken blocks left.

        A round offers a copy of every document that fits and has copies left, those with the fewest
        copies first and in the permuted order of blocks. Whole groups are taken while there is
        room; of the next one, the largest that fit. A round takes half the room at least, or all
        that is offered, so rounds are few, and only the first reads all sizes.
        """
        rooms = plan.filter("left >= 1").select(F.col("mix__of").alias("source"), F.col("left").alias("room"))
        known = self.sources.select(F.col("source").alias("s"), "n_blocks")
        of = plan.select("mix__of", "mix__nr", "n_whole", "mix__picks")
        limit = rooms.select(F.col("source").alias("r"), "room")
        spare = written(
            slim.filter("mix__size > 0")
            .join(small_side(limit), _same_source("mix__source", "r") & (F.col("mix__size") <= F.col("room")))
            .join(small_side(known), _same_source("mix__source", "s"))
            .withColumn("block", _block_of(seed, F.col("mix__row"), F.col("n_blocks")))
            .groupBy(F.col("mix__source").alias("source"), "block", F.col("mix__row").alias("row"))
            .agg(F.sum("mix__size").alias("size"))
            .join(
                small_side(of),
                _same_source("source", "mix__of") & (F.col("block") == F.col("mix__nr")),
                "left",
            )
            .select(
                "source",
                "block",
                "row",
                "size",
                (
                    F.coalesce("n_whole", F.lit(0))
                    + F.coalesce(F.array_contains("mix__picks", F.col("row")).cast("long"), F.lit(0))
                ).alias("copies"),
            )
            .filter(F.col("copies") < most),
            "spare",
        )
        rounds: list[DataFrame] = []
        while True:
            offered = spare.join(
                small_side(rooms.select(F.col("source").alias("r"), "room")),
                _same_source("source", "r") & (F.col("size") <= F.col("room")),
            ).drop("r")
            for before in rounds:
                again = before.select(F.col("source").alias("t"), F.col("row").alias("t_row"), F.lit(1).alias("n"))
                offered = offered.join(
                    small_side(again), _same_source("source", "t") & (F.col("row") == F.col("t_row")), "left"
                )
                offered = offered.withColumn("copies", F.col("copies") + F.coalesce("n", F.lit(0)))
                offered = offered.drop("t", "t_row", "n")
            taken = written(self._round(offered.filter(F.col("copies") < most), seed), f"more{len(rounds)}")
            if taken.isEmpty():
                break
            rounds.append(taken)
            used = taken.groupBy(F.col("source").alias("u")).agg(F.sum("size").alias("used"))
            rooms = written(
                rooms.join(small_side(used), _same_source("source", "u"), "left").select(
                    "source", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")
                ),
                f"room{len(rounds)}",
            )
        drawn = taken.select("source", "row").withColumn("shard", F.lit(0))
        for k, some in enumerate(rounds):
            shard = F.pmod(_hash(seed, F.lit("more"), F.lit(k), "row"), F.lit(shards)).cast("int")
            drawn = drawn.unionByName(some.select("source", "row", shard.alias("shard")))
        return written(
            drawn.groupBy(F.col("source").alias("more__of"), F.col("row").alias("more__row")).agg(
                F.sort_array(F.collect_list("shard")).alias("more__shards")
            ),
            "more",
        )

    def _round(self, offered: DataFrame, seed: int) -> DataFrame:
        """``(source, row, size)`` taken of the offered documents, by groups of a block."""
        groups = offered.groupBy("source", "copies", "block", "room").agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy(
            "copies", _hash(seed, F.lit("permute"), "source", "block"), "block"
        )
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = groups.withColumn("end", F.sum("words").over(so_far)).select(
            F.col("source").alias("g"),
            F.col("copies").alias("g_copies"),
            F.col("block").alias("g_block"),
            (F.col("end") <= F.col("room")).alias("all"),
            (F.col("room") - (F.col("end") - F.col("words"))).alias("space"),
        )
        open_groups = written(ranked.filter("space > 0"), "groups")
        units = offered.join(
            small_side(open_groups),
            _same_source("source", "g") & (F.col("copies") == F.col("g_copies")) & (F.col("block") == F.col("g_block")),
        )
        listed = units.filter("not all").groupBy("source", "copies", "block", "space")
        sized = F.struct(-F.col("size"), _hash(seed, F.lit("pick"), "row"), "row")
        picked = listed.agg(F.sort_array(F.collect_list(sized), True).alias("units")).select(
            "source", F.explode(_largest_first(F.col("space"))["picked"]).alias("p")
        )
        return (
            units.filter("all")
            .select("source", "row", "size")
            .unionByName(picked.select("source", F.col("p.row").alias("row"), F.col("p.size").alias("size")))
        )

    def _picks(self, slim: DataFrame, taken: DataFrame, seed: int) -> DataFrame:
        """The rows that fill a partly taken block: largest first, each that still fits.

        One block of each source is partly taken, so a group is a block: bounded by its making.
        Rows repeated as a whole are one unit.
        """
        open_blocks = taken.filter("part").select(
            F.col("source").alias("p_source"), F.col("block").alias("p_block"), "room"
        )
        known = self.sources.select(F.col("source").alias("s"), "n_blocks")
        units = (
            slim.join(small_side(known), _same_source("mix__source", "s"))
            .withColumn("block", _block_of(seed, F.col("mix__row"), F.col("n_blocks")))
            .join(
                small_side(open_blocks),
                _same_source("mix__source", "p_source") & (F.col("block") == F.col("p_block")),
            )
            .groupBy("p_source", "p_block", "room", F.col("mix__row").alias("row"))
            .agg(F.sum("mix__size").alias("size"))
        )
        listed = units.groupBy("p_source", "p_block", "room").agg(
            F.sort_array(
                F.collect_list(F.struct(-F.col("size"), _hash(seed, F.lit("pick"), "row"), "row")), True
            ).alias("units")
        )
        fold = _largest_first(F.col("room"))
        picks = F.transform(fold["picked"], lambda p: p["row"])
        return listed.select("p_source", "p_block", picks.alias("picks"), fold["room"].alias("left"))

    def copies(self) -> DataFrame:
        """One row of ``docs`` per drawn copy, in shards, each shuffled within itself.

        A shard is a run of neighbouring rows of one partition, so of one file when written.
        """
        drawn = self.rows.select(
            *self.docs.columns, "mix__row", F.posexplode("mix__shards").alias("mix__copy", "mix__shard")
        )
        order = _hash(self.seed, F.lit("shuffle"), "mix__row", "mix__copy", "mix__shard")
        return (
            drawn.withColumn("mix__order", order)
            .repartition(self.shards, "mix__shard")
            .sortWithinPartitions("mix__shard", "mix__order")
            .select(*self.docs.columns)
        )
