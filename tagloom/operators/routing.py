"""Routing scores: outcomes of models per tag, the tag-model score table, routes and reports.

The score matrix is wide, one column per model. The model list is given by the caller and short,
so per-sample work (best score, outcomes, routes) is a row expression over those columns; only
vocabulary-sized results are turned into one row per model. Nothing is multiplied by the number
of models before it has been aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagloom.functions.lookup import lookup_of
from tagloom.functions.text import let, or_empty, strip
from tagloom.operators.normalize import numbered_records

# What an outcome adds to the score of a model, in hundredths.
POINTS = {"win": 100, "tie": 15, "loss": -100}
LONG_TEXT = 10
MAX_PARTIAL = 3


# --- matrix ----------------------------------------------------------------------------------


def score_value(field: T.StructField, *, omit_text: bool = True) -> Column:
    """A matrix cell as a number: missing and unreadable cells count 0.

    With ``omit_text`` lists and texts longer than ten characters are no score at all (NULL).
    """
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.nanvl(cell.cast("double"), F.lit(0.0)), F.lit(0.0))
    if isinstance(field.dataType, T.StringType):
        value = F.coalesce(F.nanvl(cell.try_cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.when(F.length(cell) > LONG_TEXT, None).otherwise(value) if omit_text else value
    return F.lit(None).cast("double") if omit_text else F.lit(0.0)


def clean_matrix(
    matrix: DataFrame, models: Sequence[str], *, key: str = "sample_id", omit_text: bool = True
) -> DataFrame:
    """Key and model columns only, as doubles."""
    return matrix.select(
        key, *[score_value(matrix.schema[m], omit_text=omit_text).alias(m) for m in models]
    )


def _per_model(models: Sequence[str], fields) -> Column:
    """``inline``-able array with one struct per model; ``fields(i, model)`` lists its columns."""
    return F.inline(F.array(*[F.struct(*fields(i, m)) for i, m in enumerate(models, 1)]))


def scores_long(clean: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(sample_id, pos, model, score)`` without omitted cells."""
    rows = _per_model(
        models,
        lambda i, m: [F.lit(i).alias("pos"), F.lit(m).alias("model"), F.col(m).alias("score")],
    )
    return clean.select("sample_id", rows).filter(F.col("score").isNotNull())


def best_score(models: Sequence[str]) -> Column:
    """Highest score of a row; NULL when every cell was omitted."""
    return F.greatest(*[F.col(m) for m in models]) if len(models) > 1 else F.col(models[0])


def outcome(
    score: Column, best: Column, *, win: object = "win", tie: object = "tie", loss: object = "loss"
) -> Column:
    return (
        F.when(score.isNull(), None)
        .when((score == best) & (score > 0), win)
        .when(score == 0, loss)
        .otherwise(tie)
    )


def outcomes_wide(clean: DataFrame, models: Sequence[str]) -> DataFrame:
    best = best_score(models)
    return clean.select("sample_id", *[outcome(F.col(m), best).alias(m) for m in models])


def outcomes_long(clean: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(sample_id, model, outcome)``."""
    rows = _per_model(
        models, lambda _, m: [F.lit(m).alias("model"), F.col(m).alias("outcome")]
    )
    return outcomes_wide(clean, models).select("sample_id", rows).filter("outcome IS NOT NULL")


def dedup_rows(df: DataFrame, key: str, order: str | Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row per key in ``order``, as a partial aggregate instead of a sort: a
    key with very many rows is reduced before it is shuffled."""
    orders = [order] if isinstance(order, str) else list(order)
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(key).agg(pick(row, F.struct(*orders)).alias("row"))
    return picked.select(key, "row.*")


def ground_truth(models: Sequence[str]) -> Column:
    """Models with a score of exactly 1; else up to three best between 0 and 1; else none."""
    cells = F.array(
        *[
            F.struct(F.col(m).alias("score"), F.lit(-i).alias("rank"), F.lit(m).alias("model"))
            for i, m in enumerate(models)
        ]
    )

    def names(items: Column) -> Column:
        return F.transform(items, lambda c: c["model"])

    perfect = F.filter(cells, lambda c: c["score"] == 1.0)
    partial = F.filter(cells, lambda c: (c["score"] > 0) & (c["score"] < 1))
    best = F.slice(F.sort_array(partial, asc=False), 1, MAX_PARTIAL)
    return F.when(F.size(perfect) > 0, names(perfect)).otherwise(names(best))


def oracle_model(models: Sequence[str], none: str) -> Column:
    """The first model with the highest score, or ``none`` when no model scores."""
    best = best_score(models)
    chosen = F.lit(none)
    for m in reversed(models):
        chosen = F.when(F.col(m) == best, F.lit(m)).otherwise(chosen)
    return F.when(best > 0, chosen).otherwise(F.lit(none))


def candidate_models(samples: DataFrame, oracle: str = "oracle") -> DataFrame:
    return samples.select(F.col(oracle).alias("model")).distinct().orderBy("model")


# --- tag-model scores ------------------------------------------------------------------------


def _tagged_outcomes(
    sample_tags: DataFrame, clean: DataFrame, models: Sequence[str], **values: object
) -> DataFrame:
    """One row per tag of a sample with the outcome of every model, NULL where the sample is not
    in the matrix. ``values`` replaces the outcome names."""
    best = best_score(models)
    return (
        sample_tags.select("sample_id", "tag")
        .join(clean, "sample_id", "left")
        .select("tag", *[outcome(F.col(m), best, **values).alias(m) for m in models])
    )


def tag_model_outcomes(
    sample_tags: DataFrame, clean: DataFrame, models: Sequence[str]
) -> DataFrame:
    """``(tag, model, win, tie, loss)`` for pairs that were compared.

    Counts are kept in one row per tag until they are final: a tag that a third of all samples
    carry is one row per task once map-side counts are done.
    """
    kinds = list(POINTS)
    counts = [F.count_if(F.col(m) == k).alias(f"{m}_{k}") for m in models for k in kinds]
    rows = _per_model(
        models,
        lambda _, m: [F.lit(m).alias("model"), *[F.col(f"{m}_{k}").alias(k) for k in kinds]],
    )
    wide = _tagged_outcomes(sample_tags, clean, models).groupBy("tag").agg(*counts)
    return wide.select("tag", rows).filter("win + tie + loss > 0")


def _weight(freq: Column, total: Column) -> Column:
    return (1 - F.exp(-freq.cast("double"))) / total


def tag_weight(sample_tags: DataFrame) -> DataFrame:
    """``(tag, freq, weight)``; the weights refer to all tag occurrences."""
    counts = sample_tags.groupBy("tag").agg(F.count("*").alias("freq"))
    total = counts.agg(F.sum("freq").alias("n")).scalar()
    return counts.withColumn("weight", _weight(F.col("freq"), total))


def tag_scores_wide(
    sample_tags: DataFrame, clean: DataFrame, models: Sequence[str]
) -> DataFrame:
    """The score table with one row per tag and one column per model.

    The frequency counts samples that are absent from the matrix too, the outcomes cannot; a
    pair that was never compared scores 0. Whole points add up the same in any order.
    """
    sums = _tagged_outcomes(sample_tags, clean, models, **POINTS).groupBy("tag").agg(
        F.count("*").alias("freq"), *[F.sum(m).alias(m) for m in models]
    )
    # The frequencies add up to all occurrences: the total needs no scan of its own.
    total = sums.agg(F.sum("freq").alias("n")).scalar()
    weight = _weight(F.col("freq"), total)
    points = [F.coalesce(F.col(m), F.lit(0)) / 100.0 for m in models]
    return sums.withColumn("weight", weight).select(
        "tag", *[(F.col("weight") * p).alias(m) for p, m in zip(points, models)]
    )


def tag_model_scores(tag_scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(tag, model, score)`` from the wide table."""
    rows = _per_model(models, lambda _, m: [F.lit(m).alias("model"), F.col(m).alias("score")])
    return tag_scores.select("tag", rows)


def top_tag_models(tag_scores: DataFrame, models: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` entries with the largest absolute score."""
    strength = F.round(F.abs("score"), 12)
    return tag_model_scores(tag_scores, models).orderBy(F.desc(strength), "tag", "model").limit(k)


# --- routes and reports ----------------------------------------------------------------------


def route_samples(
    sample_tags: DataFrame, tag_scores: DataFrame, models: Sequence[str]
) -> DataFrame:
    """``(sample_id, model)``: the model with the highest sum of tag scores.

    Unknown tags add nothing; equal sums go to the first model in column order. The score table
    has one row per tag, so the join is a broadcast while it is small and a plain one beyond.
    """
    totals = (
        sample_tags.select("sample_id", "tag")
        .join(tag_scores, "tag", "left")
        .groupBy("sample_id")
        .agg(*[F.round(F.sum(F.coalesce(F.col(m), F.lit(0.0))), 12).alias(m) for m in models])
    )
    sums = F.array(*[F.col(m) for m in models])
    names = F.array(*[F.lit(m) for m in models])
    best = F.array_position(sums, F.array_max(sums)).cast("int")
    return totals.select("sample_id", F.element_at(names, best).alias("model"))


def route_records(
    records: DataFrame,
    tag_scores: DataFrame,
    models: Sequence[str],
    *,
    key: str = "sample_id",
    tags: str = "tags",
) -> DataFrame:
    """``route_samples`` for records that hold their tags as a list; those without are dropped.

    With a score table small enough for a lookup every record is routed in its own row and
    nothing is shuffled. Otherwise its tags' scores are joined and put in list order again: the same
    sums in the same order, also where keys are repeated or NULL.
    """
    tagged = records.filter(F.size(tags) > 0)
    row = F.array(*[F.col(m) for m in models])
    zero = F.array(*[F.lit(0.0) for _ in models])
    lookup = lookup_of(tag_scores, "tag", row, "array<double>")
    if lookup is not None:
        scores = F.transform(tags, lookup.get)
    else:
        numbered = numbered_records(tagged.select(key, tags))
        placed = numbered.select("_row", key, F.posexplode(tags).alias("pos", "tag"))
        found = placed.join(tag_scores.select("tag", row.alias("scores")), "tag", "left")
        tagged = found.groupBy("_row", key).agg(
            F.sort_array(F.collect_list(F.struct("pos", "scores"))).alias("placed")
        )
        scores = F.transform("placed", lambda x: x["scores"])

    def add(sums: Column, scores: Column) -> Column:
        return F.zip_with(sums, F.coalesce(scores, zero), lambda a, b: a + b)

    sums = F.aggregate(scores, zero, add)
    rounded = F.transform(sums, lambda total: F.round(total, 12))
    names = F.array(*[F.lit(m) for m in models])

    def best(totals: Column) -> Column:
        place = F.array_position(totals, F.array_max(totals)).cast("int")
        return F.element_at(names, place)

    return tagged.select(key, let(rounded, best).alias("model"))


def _cell(model: Column, models: Sequence[str], *, fold_case: bool = False) -> Column:
    """The score of a named model; 0 when no column has that name."""
    value = F.lit(0.0)
    for m in reversed(models):
        same = F.lower(model) == m.lower() if fold_case else model == m
        value = F.when(same, F.coalesce(F.col(m), F.lit(0.0))).otherwise(value)
    return value


def routed_scores(
    clean: DataFrame,
    routes: DataFrame,
    models: Sequence[str],
    samples: DataFrame | None = None,
) -> DataFrame:
    """Samples found in the matrix with the score of their route and the best score.

    ``samples`` names them and may carry more columns; without it they are the matrix rows. A
    sample without tags has no route and scores 0.
    """
    found = clean if samples is None else samples.join(clean, "sample_id")
    best = F.greatest(F.coalesce(best_score(models), F.lit(0.0)), F.lit(0.0))
    return found.join(routes, "sample_id", "left").select(
        *[c for c in found.columns if c not in models],
        "model",
        _cell(F.col("model"), models).alias("routed"),
        best.alias("best"),
    )


def route_report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of the best and the routed score, their ratio and the models chosen."""
    routed, best = F.sum("routed"), F.sum("best")
    return scored.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.round(best, 2).alias("maximum_score"),
        F.round(routed, 2).alias("routed_score"),
        F.round(F.coalesce(F.try_divide(routed, best), F.lit(0.0)), 4).alias("ratio"),
        F.count_distinct("model").alias("distinct_models"),
    )


def prediction_scores(
    predictions: DataFrame, clean: DataFrame, models: Sequence[str], prediction: str = "prediction"
) -> DataFrame:
    """Score of each predicted model (looked up without case) next to the best score.

    Samples missing from the matrix stay, with ``found`` false.
    """
    wanted = strip(or_empty(F.col(prediction)))
    best = F.coalesce(best_score(models), F.lit(0.0))
    return predictions.join(clean.withColumn("found", F.lit(True)), "sample_id", "left").select(
        "sample_id",
        wanted.alias("prediction"),
        F.coalesce("found", F.lit(False)).alias("found"),
        _cell(wanted, models, fold_case=True).alias("predict_score"),
        best.alias("maximum_score"),
    )


def score_report(scored: DataFrame) -> DataFrame:
    """Totals, averages, ratio and coverage. The average prediction refers to samples found in
    the matrix, the average maximum to all samples."""
    found = F.col("found")
    predict = F.sum(F.when(found, F.col("predict_score")).otherwise(0.0))
    maximum = F.sum(F.when(found, F.col("maximum_score")).otherwise(0.0))
    n_found, n_all = F.count_if(found), F.count("*")

    def share(part: Column, whole: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)

    return scored.agg(
        F.round(predict, 6).alias("total_predict_score"),
        F.round(maximum, 6).alias("total_maximum_score"),
        share(predict, n_found).alias("avg_predict_score"),
        share(maximum, n_all).alias("avg_maximum_score"),
        share(predict, maximum).alias("score_ratio"),
        share(n_found, n_all).alias("coverage"),
        n_found.alias("valid_predictions"),
        n_all.alias("total_samples"),
        F.count_if(~found).alias("missing_samples"),
    )


def missing_samples(samples: DataFrame, matrix: DataFrame) -> DataFrame:
    return samples.select("sample_id").join(matrix.select("sample_id"), "sample_id", "left_anti")
