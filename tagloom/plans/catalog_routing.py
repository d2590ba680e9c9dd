"""Registered queries: routing scores and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.functions import responses as J
from tagloom.functions import routes
from tagloom.operators import evaluation as V
from tagloom.operators import routing as R
from tagloom.plans.catalog_records import (
    GROUND_TRUTH,
    ORACLE_MODEL,
    docs,
    models_long,
    routing_samples,
    split_of,
    ws,
)
from tagloom.plans.catalog_tags import (
    BASIC,
    CLEAN_ANSWER,
    ROUTE_LENIENT,
    ROUTE_MULTI,
    ROUTE_SINGLE,
)
from tagloom.plans.fixtures import MODELS, sample_tags, table, view, with_views
from tagloom.plans.routing import learn_scores, route_all, route_by_split


def _matrix(spark, sf) -> DataFrame:
    return R.clean_matrix(view(spark, sf, "fx_scores"), MODELS)


_tags = sample_tags


def _labelled_matrix(spark, sf) -> DataFrame:
    """A matrix that covers only the labelled samples."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    return _matrix(spark, sf).join(labels, "sample_id", "left_semi")


def sample_max_score(spark, sf):
    return _matrix(spark, sf).select("sample_id", R.best_score(MODELS).alias("max_score"))


def model_outcomes(spark, sf):
    return R.outcomes_long(_matrix(spark, sf), MODELS)


def tag_model_wtl(spark, sf):
    return R.tag_model_outcomes(_tags(spark, sf), _matrix(spark, sf), MODELS)


def tag_weight(spark, sf):
    return R.tag_weight(_tags(spark, sf)).withColumn("weight", F.round("weight", 12))


def _tag_scores(spark, sf) -> DataFrame:
    return R.tag_scores_wide(_tags(spark, sf), _matrix(spark, sf), MODELS)


def tag_model_score(spark, sf):
    rows = R.tag_model_scores(_tag_scores(spark, sf), MODELS)
    return rows.withColumn("score", F.round("score", 9))


def tag_model_top(spark, sf):
    rows = R.top_tag_models(_tag_scores(spark, sf), MODELS)
    return rows.withColumn("score", F.round("score", 9))


def route_by_tags(spark, sf):
    scores = learn_scores(_tags(spark, sf), _matrix(spark, sf), MODELS)
    return R.route_samples(_tags(spark, sf), scores, MODELS)


def route_tag_lists(spark, sf):
    """The same routes for records that hold their tags as a list."""
    scores = learn_scores(_tags(spark, sf), _matrix(spark, sf), MODELS)
    size = F.concat(F.lit("len "), (F.col("n_chars") % 7).cast("string"))
    records = docs(spark, sf, "source", "lang", "n_chars").select(
        "sample_id", F.array("source", "lang", size, F.lit("unknown")).alias("tags")
    )
    return R.route_records(records, scores, MODELS)


def route_summary(spark, sf):
    return route_all(_tags(spark, sf), view(spark, sf, "fx_scores"), MODELS)


def route_train_val(spark, sf):
    matrix = view(spark, sf, "fx_scores")
    splits = matrix.select("sample_id", split_of("sample_id").alias("split"))
    return route_by_split(_tags(spark, sf), matrix, MODELS, splits)


def _predictions(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_predictions").select(
        "sample_id", routes.route_single(F.col("raw_generated_text")).alias("prediction")
    )


def prediction_score(spark, sf):
    return R.prediction_scores(_predictions(spark, sf), _matrix(spark, sf), MODELS)


def score_report(spark, sf):
    return R.score_report(
        R.prediction_scores(_predictions(spark, sf), _labelled_matrix(spark, sf), MODELS)
    )


def missing_samples(spark, sf):
    return R.missing_samples(_predictions(spark, sf), _labelled_matrix(spark, sf))


def dedup_first_last(spark, sf):
    """First and last value of every user, as rows that repeat a key."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), "event_id", "event_type", "value"
    )
    first = R.dedup_rows(rows, "sample_id", "event_id", "first")
    last = R.dedup_rows(rows, "sample_id", "event_id", "last")
    return first.withColumn("keep", F.lit("first")).unionByName(
        last.withColumn("keep", F.lit("last"))
    )


def ground_truth_models(spark, sf):
    return _matrix(spark, sf).select(
        "sample_id", F.array_join(R.ground_truth(MODELS), "|").alias("models")
    )


def candidate_models(spark, sf):
    return R.candidate_models(routing_samples(spark, sf))


# --- evaluation ------------------------------------------------------------------------------


def _judged(spark, sf, answer, match) -> DataFrame:
    """Predictions next to the oracle model, judged, with their split."""
    answers = view(spark, sf, "fx_predictions").select(
        "sample_id", answer(F.col("raw_generated_text")).alias("prediction")
    )
    samples = routing_samples(spark, sf).select("sample_id", "oracle")
    return (
        answers.join(samples, "sample_id")
        .withColumn("split", split_of("sample_id"))
        .withColumn("is_correct", match(F.col("prediction"), F.col("oracle")))
    )


def _exact(spark, sf) -> DataFrame:
    return _judged(spark, sf, routes.route_single, V.exact_match)


def accuracy_exact(spark, sf):
    return V.accuracy(_exact(spark, sf))


def accuracy_lenient(spark, sf):
    return V.accuracy(_judged(spark, sf, routes.route_lenient, V.lenient_match), by=["split"])


def accuracy_set(spark, sf):
    answers = view(spark, sf, "fx_predictions").select(
        "sample_id", routes.route_multi(F.col("raw_generated_text")).alias("prediction")
    )
    truth = _matrix(spark, sf).select("sample_id", R.ground_truth(MODELS).alias("truth"))
    judged = answers.join(truth, "sample_id").withColumn(
        "is_correct", V.set_match(F.col("prediction"), F.col("truth"))
    )
    return judged.select("sample_id", "is_correct")


def overfit_report(spark, sf):
    candidates = R.candidate_models(routing_samples(spark, sf))
    return V.overfit_report(_exact(spark, sf), candidates.agg(F.count("*").alias("n")).scalar())


def prediction_distribution(spark, sf):
    return V.prediction_distribution(_exact(spark, sf))


def failed_cases(spark, sf):
    return V.failed_cases(_exact(spark, sf)).select(
        "split", "rank", "sample_id", F.col("oracle").alias("expected"), "prediction"
    )


def _tag_lists(spark, sf) -> DataFrame:
    """Parsed tags of an answer next to the tags it should have."""
    return view(spark, sf, "fx_responses").select(
        "sample_id",
        J.tags_basic(F.col("raw_response")).alias("basic"),
        J.tags_comma(F.col("raw_response")).alias("comma"),
        F.array("source", "lang").alias("gold"),
    )


def tag_f1_exact(spark, sf):
    return _tag_lists(spark, sf).select(
        "sample_id", F.round(V.exact_f1(F.col("basic"), F.col("gold")), 6).alias("f1")
    )


def tag_f1_delta(spark, sf):
    lists = _tag_lists(spark, sf)
    both = F.inline(
        F.array(
            *[
                F.struct(F.lit(phase).alias("phase"), V.exact_f1(F.col(c), F.col("gold")).alias("f1"))
                for phase, c in (("before", "comma"), ("after", "basic"))
            ]
        )
    )
    return V.f1_delta(lists.select(both))


def tag_f1_semantic(spark, sf):
    """Tags are named after vectors; gold tags sit next to the predicted ones in the table."""
    vectors = table(spark, sf, "embeddings").select(
        F.concat(F.lit("src"), "vec_id").alias("tag"),
        V.unit_vector(F.col("embedding")).alias("vector"),
    )
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    records = docs(spark, sf).select(
        "sample_id",
        F.array("source", "lang").alias("predicted"),
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.lit("src"), number * k)).alias("gold"),
    )
    scored = V.semantic_f1(records, vectors)
    return scored.withColumn("f1", F.round("f1", 6))


QUERIES = {
    f.__name__: f
    for f in (
        sample_max_score, model_outcomes, tag_model_wtl, tag_weight, tag_model_score,
        tag_model_top, route_by_tags, route_tag_lists, route_summary, route_train_val, prediction_score,
        score_report, missing_samples, dedup_first_last, ground_truth_models, candidate_models,
        accuracy_exact, accuracy_lenient, accuracy_set, overfit_report, prediction_distribution,
        failed_cases, tag_f1_exact, tag_f1_delta, tag_f1_semantic,
    )
}


# --- the same results in SQL -----------------------------------------------------------------

SCORES = {"scores_l": models_long("fx_scores")}
BEST = {**SCORES, "best": "SELECT sample_id, max(score) AS best FROM scores_l GROUP BY sample_id"}
OUTCOMES = {
    **BEST,
    "outcomes": """SELECT sample_id, pos, model, score, CASE WHEN score = best AND score > 0 THEN 'win'
        WHEN score = 0 THEN 'loss' ELSE 'tie' END AS outcome FROM scores_l JOIN best USING (sample_id)""",
}


def score_table(where: str = "TRUE") -> dict[str, str]:
    """Views for the tag-model score table learned from the samples that meet a condition."""
    return {
        **OUTCOMES,
        "train_tags": f"SELECT * FROM fx_stags WHERE {where}",
        "wtl": """SELECT tag, model, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'tie') AS tie,
            count(*) FILTER (outcome = 'loss') AS loss FROM train_tags JOIN outcomes USING (sample_id) GROUP BY tag, model""",
        "weights": """SELECT tag, freq, (1 - exp(-CAST(freq AS DOUBLE))) / (SELECT count(*) FROM train_tags) AS weight
            FROM (SELECT tag, count(*) AS freq FROM train_tags GROUP BY tag) f""",
        "tag_scores": """SELECT tag, model, weight * (win * 1.0::DOUBLE + tie * 0.15::DOUBLE - loss * 1.0::DOUBLE) AS score
            FROM wtl JOIN weights USING (tag)""",
    }


def routed(where: str = "TRUE") -> dict[str, str]:
    return {
        **score_table(where),
        "sums": """SELECT sample_id, m.pos, m.model, round(sum(coalesce(s.score, 0)), 12) AS total
            FROM fx_stags t CROSS JOIN (SELECT DISTINCT pos, model FROM scores_l) m
            LEFT JOIN tag_scores s ON s.tag = t.tag AND s.model = m.model GROUP BY ALL""",
        "routes": "SELECT sample_id, min_by(model, (-total, pos)) AS model FROM sums GROUP BY sample_id",
        "routed": """SELECT sample_id, model, score AS routed, best FROM routes JOIN scores_l USING (sample_id, model)
            JOIN best USING (sample_id)""",
    }


_REPORT = """count(*) AS samples, round(sum(best), 2) AS maximum_score, round(sum(routed), 2) AS routed_score,
  round(sum(routed) / sum(best), 4) AS ratio, count(DISTINCT model) AS distinct_models"""
_SPLIT = "CASE WHEN sample_id % 5 < 4 THEN 'train' ELSE 'val' END"
PREDICTED = {
    "predicted": f"SELECT sample_id, {ROUTE_SINGLE} AS prediction FROM (SELECT sample_id, {CLEAN_ANSWER} AS a FROM fx_predictions) t"
}
SCORED = {
    **BEST,
    **PREDICTED,
    "scored": f"""SELECT p.sample_id, {ws('p.prediction')} AS prediction, coalesce(s.score, 0.0) AS predict_score,
        b.best AS maximum_score FROM predicted p JOIN best b USING (sample_id)
        LEFT JOIN scores_l s ON s.sample_id = p.sample_id AND s.model = lower({ws('p.prediction')})""",
}
JUDGED = {
    **SCORES,
    **PREDICTED,
    "oracles": ORACLE_MODEL,
    "judged": f"""SELECT sample_id, prediction, oracle, prediction = oracle AS is_correct, {_SPLIT} AS split
        FROM predicted JOIN oracles USING (sample_id)""",
}
_SHARE = "round(CAST(count(*) FILTER ({c}) AS DOUBLE) / count(*), 6)"
LENIENT = f"""SELECT sample_id, oracle, {_SPLIT} AS split, {ROUTE_LENIENT} AS p FROM
  (SELECT sample_id, raw_generated_text AS a FROM fx_predictions) t JOIN oracles USING (sample_id)"""


def _f1(predicted: str, gold: str) -> str:
    common = f"len(list_intersect({predicted}, {gold}))"
    return f"""CASE WHEN len({predicted}) = 0 AND len({gold}) = 0 THEN 1.0 WHEN {common} = 0 THEN 0.0
      ELSE 2.0 * ({common}::DOUBLE / len(list_distinct({predicted}))) * ({common}::DOUBLE / len(list_distinct({gold})))
       / ({common}::DOUBLE / len(list_distinct({predicted})) + {common}::DOUBLE / len(list_distinct({gold}))) END"""


TAG_LISTS = {
    "lists": f"""SELECT sample_id, ({BASIC})[1:5] AS basic, [source, lang] AS gold,
      list_filter(list_transform(string_split(raw_response, ','), lambda x: {ws('x')}), lambda x: x <> '')[1:5] AS comma
    FROM fx_responses"""
}

ORACLES = {
    "sample_max_score": with_views("SELECT sample_id, best AS max_score FROM best", **BEST),
    "model_outcomes": with_views("SELECT sample_id, model, outcome FROM outcomes", **OUTCOMES),
    "tag_model_wtl": with_views("SELECT tag, model, win, tie, loss FROM wtl", **score_table()),
    "tag_weight": with_views("SELECT tag, freq, round(weight, 12) AS weight FROM weights", **score_table()),
    "tag_model_score": with_views("SELECT tag, model, round(score, 9) AS score FROM tag_scores", **score_table()),
    "tag_model_top": with_views(
        "SELECT tag, model, round(score, 9) AS score FROM tag_scores ORDER BY round(abs(tag_scores.score), 12) DESC, tag, model LIMIT 5",
        **score_table(),
    ),
    "route_by_tags": with_views("SELECT sample_id, model FROM routes", **routed()),
    "route_tag_lists": with_views("SELECT sample_id, model FROM routes", **routed()),
    "route_summary": with_views(f"SELECT {_REPORT} FROM routed", **routed()),
    "route_train_val": with_views(
        f"SELECT {_SPLIT} AS split, {_REPORT} FROM routed GROUP BY 1", **routed("sample_id % 5 < 4")
    ),
    "prediction_score": with_views(
        "SELECT sample_id, prediction, TRUE AS found, predict_score, maximum_score FROM scored", **SCORED
    ),
    "score_report": with_views(
        """SELECT round(sum(predict_score) FILTER (f), 6) AS total_predict_score, round(sum(maximum_score) FILTER (f), 6) AS total_maximum_score,
          round(sum(predict_score) FILTER (f) / count(*) FILTER (f), 6) AS avg_predict_score,
          round(sum(maximum_score) FILTER (f) / count(*), 6) AS avg_maximum_score,
          round(sum(predict_score) FILTER (f) / sum(maximum_score) FILTER (f), 6) AS score_ratio,
          round(CAST(count(*) FILTER (f) AS DOUBLE) / count(*), 6) AS coverage, count(*) FILTER (f) AS valid_predictions,
          count(*) AS total_samples, count(*) FILTER (NOT f) AS missing_samples
        FROM (SELECT *, sample_id IN (SELECT doc_id FROM labels) AS f FROM scored) t""",
        **SCORED,
    ),
    "missing_samples": "SELECT doc_id AS sample_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "dedup_first_last": """
        SELECT user_id AS sample_id, event_id, event_type, value, 'first' AS keep FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
        UNION ALL
        SELECT user_id, event_id, event_type, value, 'last' FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "ground_truth_models": with_views(
        "SELECT sample_id, array_to_string(models, '|') AS models FROM truth", **SCORES, truth=GROUND_TRUTH
    ),
    "candidate_models": with_views(
        "SELECT DISTINCT oracle AS model FROM oracles", **SCORES, oracles=ORACLE_MODEL
    ),
    "accuracy_exact": with_views(
        f"""SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, {_SHARE.format(c='is_correct')} AS accuracy
        FROM judged""",
        **JUDGED,
    ),
    "accuracy_lenient": with_views(
        f"""SELECT split, count(*) AS total, count(*) FILTER (hit) AS correct, {_SHARE.format(c='hit')} AS accuracy FROM (
          SELECT split, p <> '' AND (contains(lower(p), lower(oracle)) OR contains(lower(oracle), lower(p))) AS hit FROM lenient) t
        GROUP BY split""",
        **SCORES,
        oracles=ORACLE_MODEL,
        lenient=LENIENT,
    ),
    "accuracy_set": with_views(
        f"""SELECT sample_id, CASE WHEN len(models) = 0 THEN p = ['no_model_correct']
            WHEN list_contains(p, 'no_model_correct') OR len(p) < len(models) THEN FALSE
            ELSE list_sort(list_distinct(list_transform(p[1:len(models)], lambda x: lower(x)))) =
                 list_sort(list_distinct(list_transform(models, lambda x: lower(x)))) END AS is_correct
        FROM (SELECT sample_id, {ROUTE_MULTI} AS p FROM fx_predictions) a JOIN truth USING (sample_id)""",
        **SCORES,
        truth=GROUND_TRUTH,
    ),
    "overfit_report": with_views(
        """SELECT * EXCLUDE (train_raw, val_raw), round(train_raw, 6) AS train_accuracy,
          round(val_raw, 6) AS val_accuracy, round(train_raw - val_raw, 6) AS gap,
          train_raw - val_raw > 0.05 AS overfit FROM (
          SELECT count(*) FILTER (split = 'train') AS train_total, count(*) FILTER (split = 'train' AND is_correct) AS train_correct,
            count(*) FILTER (split = 'val') AS val_total, count(*) FILTER (split = 'val' AND is_correct) AS val_correct,
            avg(CAST(is_correct AS INT)) FILTER (split = 'train') AS train_raw,
            avg(CAST(is_correct AS INT)) FILTER (split = 'val') AS val_raw,
            (SELECT count(DISTINCT oracle) FROM oracles) AS candidate_models FROM judged) t""",
        **JUDGED,
    ),
    "prediction_distribution": with_views(
        """SELECT prediction, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count,
          round(count(*) FILTER (split = 'train') * 100.0 / (SELECT count(*) FROM judged WHERE split = 'train'), 1) AS train_pct,
          round(count(*) FILTER (split = 'val') * 100.0 / (SELECT count(*) FROM judged WHERE split = 'val'), 1) AS val_pct
        FROM judged GROUP BY prediction""",
        **JUDGED,
    ),
    "failed_cases": with_views(
        """SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY sample_id) AS INTEGER) AS rank, sample_id, oracle AS expected,
          prediction FROM judged WHERE NOT is_correct
        QUALIFY row_number() OVER (PARTITION BY split ORDER BY sample_id) <= 5""",
        **JUDGED,
    ),
    "tag_f1_exact": with_views(
        f"SELECT sample_id, round({_f1('basic', 'gold')}, 6) AS f1 FROM lists", **TAG_LISTS
    ),
    "tag_f1_delta": with_views(
        f"""SELECT round(avg(b), 6) AS before_f1, round(avg(a), 6) AS after_f1, round(avg(a) - avg(b), 6) AS improvement
        FROM (SELECT CAST({_f1('comma', 'gold')} AS DOUBLE) AS b, CAST({_f1('basic', 'gold')} AS DOUBLE) AS a FROM lists) t""",
        **TAG_LISTS,
    ),
    "tag_f1_semantic": """
      WITH tagvec AS (SELECT 'src' || vec_id AS tag, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT doc_id, unnest([source, lang]) AS tag FROM documents),
      g AS (SELECT doc_id, k, 'src' || (CAST(replace(source, 'src', '') AS INT) * k) AS tag
            FROM documents, (VALUES (1), (2), (3)) ks(k)),
      pairs AS (SELECT p.doc_id, p.tag AS pt, g.k, list_cosine_similarity(a.v, b.v) AS s FROM p JOIN g USING (doc_id)
            JOIN tagvec a ON a.tag = p.tag JOIN tagvec b ON b.tag = g.tag),
      m AS (SELECT doc_id, count(DISTINCT pt) AS mp, count(DISTINCT k) AS mg FROM pairs WHERE s >= 0.8 GROUP BY doc_id)
      SELECT doc_id AS sample_id, round(CASE WHEN coalesce(mp, 0) + coalesce(mg, 0) = 0 THEN 0.0
        ELSE 2.0 * (mp / 2.0) * (mg / 3.0) / (mp / 2.0 + mg / 3.0) END, 6) AS f1
      FROM documents LEFT JOIN m USING (doc_id)""",
}
