"""Routing scores, reports and evaluation on hand-made rows and the golden totals."""

import math

import pytest
from pyspark.sql import functions as F

from tagloom.functions.routes import NO_MODEL
from tagloom.operators import evaluation as V
from tagloom.operators import routing as R
from tagloom.plans import catalog
from tagloom.plans.routing import learn_scores

MODELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(
        [
            (1, 1.0, 0.5, 0.0),
            (2, 1.0, 1.0, 0.0),
            (3, 0.0, 0.0, 0.0),
            (4, None, 0.25, float("nan")),
        ],
        "sample_id long, a double, b double, c double",
    )


@pytest.fixture(scope="module")
def sample_tags(spark):
    return spark.createDataFrame(
        [(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, "y"), (9, "z")], "sample_id long, tag string"
    )


def test_golden_totals(spark):
    rows = catalog.queries()["route_train_val"](spark, "/root/testdata/sf0.01").collect()
    got = {r["split"]: (r["samples"], r["maximum_score"], r["routed_score"], r["ratio"], r["distinct_models"]) for r in rows}
    assert got == {"train": (800, 654.75, 360.0, 0.5498, 11), "val": (200, 186.75, 91.0, 0.4873, 8)}


def test_cells(spark):
    rows = spark.createDataFrame(
        [(1, "0.5", 1, ["x"]), (2, "bad", None, ["x"]), (3, "0.12345678901", 2, None), (4, None, 3, None)],
        "sample_id long, a string, b int, c array<string>",
    )
    got = [tuple(r) for r in R.clean_matrix(rows, MODELS).orderBy("sample_id").collect()]
    assert got == [(1, 0.5, 1.0, None), (2, 0.0, 0.0, None), (3, None, 2.0, None), (4, 0.0, 3.0, None)]
    long = R.scores_long(R.clean_matrix(rows, MODELS), MODELS)
    assert long.count() == 7


def test_outcomes(matrix):
    clean = R.clean_matrix(matrix, MODELS)
    got = {(r[0], r[1]): r[2] for r in R.outcomes_long(clean, MODELS).collect()}
    assert [got[1, m] for m in MODELS] == ["win", "tie", "loss"]
    assert [got[2, m] for m in MODELS] == ["win", "win", "loss"]
    assert [got[3, m] for m in MODELS] == ["loss"] * 3
    assert [got[4, m] for m in MODELS] == ["loss", "win", "loss"]


def test_tag_scores(matrix, sample_tags):
    clean = R.clean_matrix(matrix, MODELS)
    wide = {r["tag"]: r for r in R.tag_scores_wide(sample_tags, clean, MODELS).collect()}
    weight = lambda n: (1 - math.exp(-n)) / 6
    # x: sample 1 twice (win, tie, loss) and sample 2 once (win, win, loss).
    assert wide["x"]["a"] == pytest.approx(weight(3) * 3)
    assert wide["x"]["b"] == pytest.approx(weight(3) * (2 * 0.15 + 1))
    assert wide["x"]["c"] == pytest.approx(weight(3) * -3)
    # z is only on a sample the matrix lacks: it counts in the total and scores 0.
    assert [wide["z"][m] for m in MODELS] == [0.0, 0.0, 0.0]
    outcomes = R.tag_model_outcomes(sample_tags, clean, MODELS)
    assert outcomes.filter("tag = 'z'").count() == 0


def test_routes_and_ties(spark, matrix, sample_tags):
    clean = R.clean_matrix(matrix, MODELS)
    scores = learn_scores(sample_tags, clean, MODELS)
    asked = spark.createDataFrame([(1, "x"), (2, "unknown"), (3, "z")], "sample_id long, tag string")
    routes = R.route_samples(asked, scores, MODELS)
    assert {r[0]: r[1] for r in routes.collect()} == {1: "a", 2: "a", 3: "a"}
    scored = {r["sample_id"]: r for r in R.routed_scores(clean, routes, MODELS).collect()}
    assert (scored[1]["routed"], scored[1]["best"]) == (1.0, 1.0)
    # Sample 4 has no tags, so no route and no score.
    assert (scored[4]["model"], scored[4]["routed"], scored[4]["best"]) == (None, 0.0, 0.25)


def test_predictions_and_report(spark, matrix):
    clean = R.clean_matrix(matrix, MODELS)
    predictions = spark.createDataFrame(
        [(1, " B "), (2, ""), (3, "nobody"), (8, "a")], "sample_id long, prediction string"
    )
    scored = R.prediction_scores(predictions, clean, MODELS)
    assert {r["sample_id"]: r["predict_score"] for r in scored.collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 8: 0.0}
    report = R.score_report(scored).first()
    assert (report["total_predict_score"], report["total_maximum_score"]) == (0.5, 2.0)
    # The averages refer to different numbers of samples; a blank prediction is still covered.
    assert report["avg_predict_score"] == round(0.5 / 3, 6)
    assert report["avg_maximum_score"] == 0.5
    assert (report["coverage"], report["valid_predictions"], report["missing_samples"]) == (0.75, 3, 1)
    assert [r[0] for r in R.missing_samples(predictions, clean).collect()] == [8]


def test_first_and_last_rows(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None), (2, 9, "z")], "k int, at int, v string")
    assert {tuple(r) for r in R.dedup_rows(rows, "k", "at").collect()} == {(1, 1, "a"), (2, 9, "z")}
    assert {tuple(r) for r in R.dedup_rows(rows, "k", "at", "last").collect()} == {(1, 3, "c"), (2, 9, "z")}


def test_ground_truth(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 0.5, 1.0, 0.2), (2, 0.5, 0.7, 0.5, 0.5), (3, 0.0, 0.0, 2.0, -1.0)],
        "i int, a double, b double, c double, d double",
    )
    got = [r[0] for r in rows.orderBy("i").select(R.ground_truth(["a", "b", "c", "d"])).collect()]
    assert got == [["a", "c"], ["b", "a", "c"], []]


def test_matches(spark):
    rows = spark.createDataFrame(
        [("m1", "M1"), ("m1 x", "m1"), ("", "m1"), (None, "m1"), ("m", "m1"), ("z", "m1")], "p string, e string"
    )
    p, e = F.col("p"), F.col("e")
    assert [r[0] for r in rows.select(V.lenient_match(p, e)).collect()] == [True, True, False, False, True, False]
    assert [r[0] for r in rows.select(V.exact_match(p, e)).collect()] == [False] * 6


@pytest.mark.parametrize(
    "predicted, expected, right",
    [
        ([NO_MODEL], [], True),
        ([NO_MODEL, NO_MODEL], [], False),
        ([], [], False),
        ([], ["a"], False),
        (["a", NO_MODEL], ["a"], False),
        (["A", "b"], ["a"], True),
        (["b", "a"], ["a", "B"], True),
        (["a"], ["a", "b"], False),
        (["a", "a", "b"], ["a", "b"], False),
    ],
)
def test_set_match(spark, predicted, expected, right):
    row = spark.createDataFrame([(predicted, expected)], "p array<string>, e array<string>")
    assert row.select(V.set_match(F.col("p"), F.col("e"))).first()[0] is right


def test_exact_f1(spark):
    cases = [([], [], 1.0), ([], ["a"], 0.0), (["a"], [], 0.0), (["a", "a", "b"], ["a"], 2 / 3), (["x"], ["a"], 0.0)]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p array<string>, g array<string>")
    got = [r[0] for r in rows.orderBy("i").select(V.exact_f1(F.col("p"), F.col("g"))).collect()]
    assert got == pytest.approx([f1 for _, _, f1 in cases])


def test_semantic_f1_uses_list_sizes(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 2.0]), ("o", [0.0, 0.0])], "tag string, v array<float>"
    ).select("tag", V.unit_vector(F.col("v")).alias("vector"))
    records = spark.createDataFrame(
        [(1, ["a", "a"], ["b", "c"]), (2, [], []), (3, ["a"], []), (4, ["o", "none"], ["a"])],
        "sample_id int, predicted array<string>, gold array<string>",
    )
    got = {r[0]: r[1] for r in V.semantic_f1(records, vectors).collect()}
    # Sample 1: both predicted tags match, one of two gold tags does.
    assert got == pytest.approx({1: 2 * 1.0 * 0.5 / 1.5, 2: 1.0, 3: 0.0, 4: 0.0})


def test_reports(spark):
    rows = spark.createDataFrame(
        [(1, "train", "a", True), (2, "train", "b", False), (3, "val", "a", False), (4, "val", "a", False)],
        "sample_id int, split string, prediction string, is_correct boolean",
    )
    report = V.overfit_report(rows, F.lit(2)).first()
    assert (report["train_accuracy"], report["val_accuracy"], report["gap"], report["overfit"]) == (0.5, 0.0, 0.5, True)
    shares = {r["prediction"]: tuple(r)[1:] for r in V.prediction_distribution(rows).collect()}
    assert shares == {"a": (1, 2, 50.0, 100.0), "b": (1, 0, 50.0, 0.0)}
    assert [r["sample_id"] for r in V.failed_cases(rows, 1).orderBy("sample_id").collect()] == [2, 3]
    empty = V.accuracy(rows.limit(0)).first()
    assert (empty["total"], empty["accuracy"]) == (0, 0.0)


def test_report_text(spark):
    rows = spark.createDataFrame(
        [(1, "train", True), (2, "train", True), (3, "train", False), (4, "val", False)],
        "sample_id int, split string, is_correct boolean",
    )
    models = spark.createDataFrame([("b",), ("a",)], "model string")
    lines = [r["line"] for r in V.report_text(V.overfit_report(rows, F.lit(2)), models).collect()]
    assert lines == [
        "Train Accuracy: 66.67% (2/3)",
        "Val Accuracy: 0.00% (0/1)",
        "Overfitting: +66.67%",
        "Candidate Models: 2",
        " 1. a",
        " 2. b",
    ]
