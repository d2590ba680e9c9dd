"""TF-IDF vectors of tags, exact similarity joins and the links that decide similarity groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.lexical import STOP_WORDS, terms_of
from tagloom.functions.text import let
from tagloom.operators.components import group_by_components
from tagloom.session import bounded_side, cut_lineage

MIN_SIMILARITY = 0.05
MAX_TERMS = 1000
# Copies of the probing side per term, so that the tags of one frequent term meet in many tasks.
TERM_SALTS = 4
_EPS = 1e-9


def tag_terms(tags: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(tag, term, tf)`` over words and word pairs, counted inside the tag's own row."""

    def counted(terms: Column) -> Column:
        return F.transform(
            F.array_distinct(terms),
            lambda term: F.struct(
                term.alias("term"),
                F.size(F.filter(terms, lambda other: other == term)).alias("tf"),
            ),
        )

    return tags.select("tag", F.inline(let(terms_of(F.col("tag"), stop_words), counted)))


def tag_vectors(
    tags: DataFrame,
    *,
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``(tag, vec)``: smoothed TF-IDF entries ``(df, term, w)`` at unit length, rare terms first.

    The vocabulary is the ``max_terms`` terms with the highest count. Tags without any of these
    terms have no row. The list of a tag is as short as its phrase.
    """
    terms = tag_terms(tags, stop_words)
    total = tags.agg(F.count("*").alias("n")).scalar()
    vocabulary = (
        terms.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
        .select("term", "df", (F.ln((total + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )
    entry = F.struct("df", "term", (F.col("tf") * F.col("idf")).alias("w"))
    raw = (
        terms.join(bounded_side(vocabulary, max_terms), "term")
        .groupBy("tag")
        .agg(F.array_sort(F.collect_list(entry)).alias("vec"))
    )
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    return raw.withColumn("length", length).select(
        "tag",
        F.transform(
            "vec",
            lambda e: F.struct(
                e["df"].alias("df"), e["term"].alias("term"), (e["w"] / F.col("length")).alias("w")
            ),
        ).alias("vec"),
    )


def tag_tfidf(vectors: DataFrame) -> DataFrame:
    """``(tag, term, df, weight)`` from the vectors."""
    return vectors.select("tag", F.inline("vec")).withColumnRenamed("w", "weight")


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors with one name each, and the links of the other tags that share them."""
    named = vectors.withColumn(
        "shape",
        F.transform("vec", lambda e: F.struct(e["term"].alias("t"), F.round(e["w"], 12).alias("w"))),
    )
    unique = named.groupBy("shape").agg(
        F.min("tag").alias("tag"), F.min_by("vec", "tag").alias("vec"), F.count("*").alias("n")
    )
    links = (
        named.join(unique.filter("n > 1").select("shape", F.col("tag").alias("named")), "shape")
        .filter(F.col("tag") != F.col("named"))
        .select(F.col("named").alias("src"), F.col("tag").alias("dst"))
    )
    return unique.select("tag", "vec"), links


def _prefix(vec: Column, min_similarity: float) -> Column:
    """Entries that must be probed: the rest is too light to reach the similarity alone.

    Two unit vectors whose shared terms all lie in the tail of one of them have a product of at
    most the length of that tail (prefix filtering for cosine similarity).
    """
    bound = min_similarity * min_similarity - _EPS
    tail_mass = F.transform(
        vec,
        lambda e, i: F.struct(
            e["term"].alias("term"),
            e["w"].alias("w"),
            F.aggregate(
                F.slice(vec, i + 1, F.size(vec)),
                F.lit(0.0),
                lambda acc, x: acc + x["w"] * x["w"],
            ).alias("mass"),
        ),
    )
    return F.filter(tail_mass, lambda e: e["mass"] >= bound)


def _dot(a: Column, b: Column) -> Column:
    """Product of two sparse vectors, added up in the order of the first one's terms."""

    def times(entry: Column) -> Column:
        same = F.filter(b, lambda other: other["term"] == entry["term"])
        return entry["w"] * F.coalesce(F.try_element_at(same, F.lit(1))["w"], F.lit(0.0))

    return F.aggregate(a, F.lit(0.0), lambda acc, entry: acc + times(entry))


def _salts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def similar_pairs(
    vectors: DataFrame, min_similarity: float, *, salts: int = TERM_SALTS
) -> DataFrame:
    """``(src, dst, cosine)`` for all pairs of distinct vectors with ``src < dst``; tags that
    share a vector are linked once to the smallest of them, with cosine 1.

    Tags meet at the rare terms of their prefix only, and a pair is formed at the first prefix
    term it shares. Probing rows are spread over ``salts`` per term and the other side is copied
    to each, so that one frequent term is many tasks.
    """
    vectors, copies = distinct_vectors(vectors)
    keys = F.transform(_prefix(F.col("vec"), min_similarity), lambda e: e["term"])

    def entries(side: str) -> DataFrame:
        return (
            vectors.withColumn("keys", keys)
            .withColumn("term", F.explode("keys"))
            .withColumnsRenamed({c: f"{side}_{c}" for c in ("tag", "vec", "keys")})
        )

    probing = entries("a").withColumn("salt", F.pmod(F.xxhash64("a_tag"), F.lit(salts)))
    probed = entries("b").withColumn("salt", _salts(salts))
    cosine = F.round(_dot(F.col("a_vec"), F.col("b_vec")), 12)
    pairs = (
        probing.join(probed, ["term", "salt"])
        .filter(F.col("a_tag") < F.col("b_tag"))
        .filter(F.array_intersect("a_keys", "b_keys")[0] == F.col("term"))
        .select(F.col("a_tag").alias("src"), F.col("b_tag").alias("dst"), cosine.alias("cosine"))
        .filter(F.col("cosine") >= min_similarity)
    )
    return pairs.unionByName(copies.withColumn("cosine", F.lit(1.0)))


def similarity_links(
    vectors: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    *,
    max_terms: int = MAX_TERMS,
    salts: int = TERM_SALTS,
) -> DataFrame:
    """Edges with the same components as all pairs at or above the similarity.

    Weights are never negative, so one shared term with a product above the bound already makes
    a pair similar: each such tag is linked to the tag heaviest in that term, one edge per
    (tag, term) instead of one per pair. Only entries too light for that still probe others,
    which covers pairs that are similar through several light terms together.
    """
    vectors, copies = distinct_vectors(vectors)
    entries = vectors.select("tag", F.explode("vec").alias("e")).select(
        "tag", F.col("e.term").alias("term"), F.col("e.w").alias("w")
    )
    hubs = entries.groupBy("term").agg(F.max(F.struct("w", "tag")).alias("hub"))
    hubs = bounded_side(hubs, max_terms)
    safe = min_similarity + _EPS
    product = F.col("w") * F.col("hub.w")
    stars = (
        entries.join(hubs, "term")
        .filter((product >= safe) & (F.col("tag") != F.col("hub.tag")))
        .select(F.col("hub.tag").alias("src"), F.col("tag").alias("dst"))
    )

    def prefixes(side: str) -> DataFrame:
        prefix = _prefix(F.col("vec"), min_similarity)
        return vectors.select(
            F.col("tag").alias(f"{side}_tag"),
            F.col("vec").alias(f"{side}_vec"),
            F.inline(F.transform(prefix, lambda e: F.struct(e["term"].alias("term"), e["w"].alias("w")))),
        )

    probing = (
        prefixes("a")
        .join(hubs, "term")
        .filter(product < safe)
        .drop("w", "hub")
        .withColumn("salt", F.pmod(F.xxhash64("a_tag"), F.lit(salts)))
    )
    probed = prefixes("b").drop("w").withColumn("salt", _salts(salts))
    cosine = F.round(_dot(F.col("a_vec"), F.col("b_vec")), 12)
    rest = (
        probing.join(probed, ["term", "salt"])
        .filter(F.col("a_tag") != F.col("b_tag"))
        .filter(cosine >= min_similarity)
        .select(F.col("a_tag").alias("src"), F.col("b_tag").alias("dst"))
    )
    return stars.unionByName(rest).unionByName(copies)


def semantic_groups(
    tags: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    *,
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Mapping of canonical tags to the smallest tag of their similarity group.

    Density clustering with a minimum of one point makes every point a core point, so a group is
    a connected component of the similarity graph. Tags without terms stay on their own.
    """
    vectors = cut_lineage(tag_vectors(tags, max_terms=max_terms, stop_words=stop_words))
    links = similarity_links(vectors, min_similarity, max_terms=max_terms)
    return group_by_components(tags, links)
