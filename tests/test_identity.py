"""Repeated and NULL keys, odd models, odd paths: the same rows whatever the table sizes."""

import pytest
from pyspark.sql import functions as F, types as T

from tagloom.operators import normalize as N
from tagloom.operators import resume
from tagloom.operators import routing as R
from tagloom.operators import sampling as L
from tagloom.operators.inference import batch_infer
from tagloom.sources import records as S


@pytest.fixture(params=["in the row", "joined"])
def size(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr("tagloom.functions.lookup.LOOKUP_BYTES", 0)


def test_cleaning_repeated_and_null_keys(spark, size):
    records = spark.createDataFrame(
        [(1, ["a", "b"]), (1, ["c"]), (None, ["a", None]), (2, ["x"]), (3, [])], "sample_id long, tags array<string>"
    )
    mapping = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "tag string, canonical string")
    got = N.clean_records(records, mapping).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 'A,B')", "(1, 'C')", "(None, 'A')"]


def test_routing_repeated_and_null_keys(spark, size):
    records = spark.createDataFrame(
        [(1, ["a"]), (1, ["b", "?"]), (None, ["a"]), (2, ["t"] * 30 + ["u"])], "sample_id long, tags array<string>"
    )
    scores = spark.createDataFrame(
        [("a", 1.0, 0.0), ("b", 0.0, 1.0), ("t", 0.1, 0.1), ("u", 1e-9, 0.0)], "tag string, m1 double, m2 double"
    )
    got = R.route_records(records, scores, ["m1", "m2"]).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 'm1')", "(1, 'm2')", "(2, 'm1')", "(None, 'm1')"]


def test_boolean_scores_count(spark):
    matrix = spark.createDataFrame([(1, True, 0.5), (2, None, 0.5)], "sample_id int, a boolean, b double")
    rows = R.clean_matrix(matrix, ["a", "b"]).orderBy("sample_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, 0.5), (2, 0.0, 0.5)]


@pytest.mark.parametrize("answers", [lambda t: ["one"], lambda t: [*t, "more"], lambda t: [1 for _ in t]])
def test_wrong_answers_fail_their_batch(spark, answers):
    rows = spark.createDataFrame([("x",), ("y",)], "full_input string").coalesce(1)
    got = batch_infer(rows, lambda: answers).collect()
    assert [r["raw_response"] for r in got] == ["Error", "Error"] and all(r["error"] for r in got)


def test_append_once_stores_one_row_per_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        stored = resume.append_once(rows, f"{tmp_path}/out", "k")
    assert sorted(r["k"] for r in stored.collect()) == [1, 2]


@pytest.mark.parametrize("root", ["in/in", "a+b", "x y/é%z"])
def test_source_is_the_entry_below_the_root(spark, tmp_path, root):
    row = spark.createDataFrame([(1,)], "i int")
    for entry in ("one", "c=two"):
        row.write.parquet(f"{tmp_path}/{root}/{entry}/in/deep")
    got = S.load_with_source(spark, f"{tmp_path}/{root}", "i int").collect()
    assert sorted(r["source"] for r in got) == ["one", "two"]


def test_malformed_lines_are_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": \n\n{"a": 2}\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        S.read_json_lines(spark, str(tmp_path), "a int").collect()


def test_all_ranks_in_few_passes(spark):
    rows = spark.range(0, 200_000).select((F.col("id") * 40_000_000_000_000 - 2**62).alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranks", "ranks")
    got = L.shard_assign(rows, "k", 20)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # A pass is two jobs where the plan is adaptive: the counts by task, and their sums.
    assert len(tracker.getJobIdsForGroup("ranks")) <= 14
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [10_000] * 20


def test_folder_of_documents_and_lines(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    (tmp_path / "deep" / "b.json").write_text('[\n {"a": 3},\n {"a": 4}\n]')
    (tmp_path / "deep" / "c.json").write_text('{\n "a": 5\n}')
    (tmp_path / "d.json").write_text('{"a": 6')
    rows = S.read_json_folder(spark, str(tmp_path), T.StructType([T.StructField("a", T.IntegerType())])).cache()
    assert sorted(r["a"] for r in S.good_rows(rows).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["line"] for r in S.bad_lines(rows).collect()) == ['{"a": ', '{"a": 6']
    first = L.limit_per_group(S.good_rows(rows), 1, "file_path", "a").collect()
    assert sorted(r["a"] for r in first) == [1, 3, 5]
