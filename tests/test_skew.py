"""One key with a third of all rows: results stay whole, group work stays small."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import normalize as N
from tagloom.operators import routing as R
from tagloom.operators import similarity as M
from tagloom.operators import sampling as L
from tagloom.plans.normalization import lexical_mapping
from tagloom.plans.routing import learn_scores

ROWS = 240_000


def occurrences(spark):
    """A third of the rows carry one tag, another third belong to one record."""
    i = F.col("id")
    return spark.range(ROWS).select(
        F.when(i % 3 == 1, -1).otherwise(i).alias("sample_id"),
        i.alias("pos"),
        F.when(i % 3 == 0, "hot tag").otherwise(F.concat(F.lit("tag "), (i % 50).cast("string"))).alias("tag"),
    )


def test_mapping_of_hot_tags_and_records(spark):
    rows = occurrences(spark)
    mapping = lexical_mapping(rows)
    cleaned = N.apply_mapping(rows, mapping)
    assert cleaned.count() == ROWS // 3 * 2 + 1
    (hot,) = cleaned.filter("sample_id = -1").collect()
    # Every tag once, in the order of its first place.
    assert len(hot["tags"].split(",")) == 50 and hot["tags"].startswith("tag 1,tag 4,tag 7")
    (top,) = N.top_tags(rows, mapping, 1).collect()
    assert (top["canonical"], top["n"]) == ("hot tag", ROWS // 3)


def test_occurrences_move_once_to_be_listed(spark):
    rows = occurrences(spark)
    plan = N.apply_mapping(rows, F.broadcast(rows.select("tag", F.col("tag").alias("canonical")).limit(1).checkpoint()))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("listed", [1, 4, 1 << 16])
def test_lists_over_batches_of_any_size(monkeypatch, listed):
    """Records that end with a batch, go on over many, have no key, or no known tag."""
    monkeypatch.setattr(N, "LISTED_ROWS", listed)
    ids = [None] * 2 + [1] * 7 + [2, 3, 3, 4, 4, 4, 5]
    tags = ["a", "a", "c", "b", "c", "a", "b", "é", "a", "a", "b", "b", None, "x", None, None]
    want = [(None, "a"), (1, "c,b,a,é"), (2, "a"), (3, "b"), (4, "x"), (5, None)]
    for size in (1, 2, 3, 5, 16):
        rows = pa.table({"sample_id": pa.array(ids, pa.int64()), "canonical": pa.array(tags, pa.string())})
        batches = [pa.RecordBatch.from_pylist([], rows.schema), *rows.to_batches(size)]
        got = [tuple(r.values()) for batch in N._lists(iter(batches)) for r in batch.to_pylist()]
        assert got == want
    assert list(N._lists(iter([]))) == []


def test_joins_too_big_to_broadcast_give_the_same(spark, monkeypatch):
    import tagloom.session as session

    rows = occurrences(spark)
    wanted = N.apply_mapping(rows, lexical_mapping(rows)).agg(F.sum(F.hash("sample_id", "tags").cast("long"))).first()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = N.apply_mapping(rows, lexical_mapping(rows))
        assert "BroadcastHashJoin" not in plain._jdf.queryExecution().executedPlan().toString()
        assert plain.agg(F.sum(F.hash("sample_id", "tags").cast("long"))).first() == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_of_a_hot_tag(spark):
    tags = spark.range(60_000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("tag"))
    matrix = spark.range(60_000).select(
        F.col("id").alias("sample_id"),
        (F.col("id") % 2).cast("double").alias("a"),
        F.lit(0.5).alias("b"),
    )
    clean = R.clean_matrix(matrix, ["a", "b"])
    counts = {(r["tag"], r["model"]): (r["win"], r["tie"], r["loss"]) for r in R.tag_model_outcomes(tags, clean, ["a", "b"]).collect()}
    assert counts["hot", "a"] == (20_000, 0, 20_000) and counts["hot", "b"] == (20_000, 20_000, 0)
    routes = R.route_samples(tags, learn_scores(tags, clean, ["a", "b"]), ["a", "b"])
    assert routes.filter("model = 'b'").count() == 60_000


def test_links_of_a_hot_term_stay_linear(spark):
    tags = spark.range(4_000).select(F.concat(F.lit("common word"), "id").alias("tag")).checkpoint()
    links = M.similarity_links(M.tag_vectors(tags).checkpoint(), 0.05)
    n = links.count()
    assert 3_999 <= n <= 12_000
    groups = M.semantic_groups(tags, 0.05)
    assert groups.select("canonical").distinct().count() == 1


def test_limits_of_a_hot_group_are_cut_inside_tasks(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("file"), "id")
    limited = L.limit_per_group(rows, 2, "file", "id")
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in limited.filter("file = 'hot'").collect()) == [1, 2]


def test_records_are_cleaned_and_routed_without_a_shuffle(spark, monkeypatch):
    import tagloom.functions.lookup as lookup

    records = spark.range(3_000).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") == 7, F.array_repeat(F.lit("hot"), 50_000))
        .when(F.col("id") == 8, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 200), F.lit("it's \"x\"\n")))
        .alias("tags"),
        F.lit("p").alias("prompt"),
    ).checkpoint()
    mapping = N.rule_mapping(records.select(F.explode("tags").alias("tag")).distinct()).checkpoint()
    scores = mapping.select("tag", F.length("tag").cast("double").alias("a"), F.lit(3.5).alias("b")).checkpoint()

    def results():
        cleaned = N.clean_records(records, mapping)
        routes = R.route_records(records, scores, ["a", "b"])
        return cleaned, routes, {tuple(r) for r in cleaned.collect()}, {tuple(r) for r in routes.collect()}

    cleaned, routes, small_tags, small_routes = results()
    for frame in (cleaned, routes):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lookup, "LOOKUP_BYTES", 0)
    _, _, big_tags, big_routes = results()
    assert small_tags == big_tags and small_routes == big_routes
    assert len(small_tags) == len(small_routes) == 2_999
    assert (7, "hot", "p") in small_tags and (7, "b") in small_routes
