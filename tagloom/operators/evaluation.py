"""Evaluation of routes and tags: match expressions, accuracy, distributions, F1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.functions.routes import NO_MODEL
from tagloom.functions.text import let, or_empty, strip

OVERFIT_GAP = 0.05
SEMANTIC_THRESHOLD = 0.8


# --- matches ---------------------------------------------------------------------------------


def exact_match(prediction: Column, expected: Column) -> Column:
    return F.coalesce(prediction == expected, F.lit(False))


def lenient_match(prediction: Column, expected: Column) -> Column:
    """Equal without case, or one contained in the other; an empty side never matches."""
    given = (or_empty(prediction) != "") & (or_empty(expected) != "")
    a, b = strip(F.lower(or_empty(prediction))), strip(F.lower(or_empty(expected)))
    return given & ((a == b) | F.contains(a, b) | F.contains(b, a))


def set_match(predictions: Column, expected: Column) -> Column:
    """As many predictions as expected models, equal as sets without case.

    Without expected models exactly the no-model marker is right; otherwise it is wrong
    anywhere among the predictions.
    """

    def folded(names: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(names, lambda n: strip(F.lower(n)))))

    k = F.size(expected)
    compared = F.slice(predictions, 1, F.greatest(k, F.lit(1)))
    some = (
        ~F.array_contains(predictions, NO_MODEL)
        & (F.size(predictions) >= k)
        & (folded(compared) == folded(expected))
    )
    only_marker = predictions == F.array(F.lit(NO_MODEL))
    return F.when(k == 0, only_marker).otherwise(some)


# --- reports ---------------------------------------------------------------------------------


def accuracy(judged: DataFrame, by: Sequence[str] = (), correct: str = "is_correct") -> DataFrame:
    hits = F.count_if(F.col(correct))
    return judged.groupBy(*by).agg(
        F.count("*").alias("total"),
        hits.alias("correct"),
        F.round(F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)), 6).alias("accuracy"),
    )


def overfit_report(
    judged: DataFrame, candidates: Column, *, split: str = "split", correct: str = "is_correct"
) -> DataFrame:
    """Accuracy of both splits in one pass, their gap, a flag for a large gap and the number of
    candidate models."""

    def of(name: str) -> tuple[Column, Column]:
        inside = F.col(split) == name
        return F.count_if(inside & F.col(correct)), F.count_if(inside)

    (train_hits, train_all), (val_hits, val_all) = of("train"), of("val")
    train = F.coalesce(F.try_divide(train_hits, train_all), F.lit(0.0))
    val = F.coalesce(F.try_divide(val_hits, val_all), F.lit(0.0))
    return judged.agg(
        train_all.alias("train_total"),
        train_hits.alias("train_correct"),
        F.round(train, 6).alias("train_accuracy"),
        val_all.alias("val_total"),
        val_hits.alias("val_correct"),
        F.round(val, 6).alias("val_accuracy"),
        F.round(train - val, 6).alias("gap"),
        (train - val > OVERFIT_GAP).alias("overfit"),
    ).withColumn("candidate_models", candidates)


def report_text(report: DataFrame, candidates: DataFrame) -> DataFrame:
    """The report of both splits and the numbered candidate models as lines ``(at, line)``."""

    def score(title: str, split: str) -> Column:
        return F.format_string(
            f"{title} Accuracy: %.2f%% (%d/%d)",
            F.col(f"{split}_accuracy") * 100,
            f"{split}_correct",
            f"{split}_total",
        )

    lines = [
        score("Train", "train"),
        score("Val", "val"),
        F.format_string("Overfitting: %+.2f%%", F.col("gap") * 100),
        F.format_string("Candidate Models: %d", "candidate_models"),
    ]
    head = report.select(F.posexplode(F.array(*lines)).alias("at", "line"))
    # One row per model of the router, so the ranking is a handful of rows.
    place = F.row_number().over(Window.orderBy("model"))
    models = candidates.select((place + len(lines) - 1).alias("at"), "model").select(
        "at", F.format_string("%2d. %s", F.col("at") - len(lines) + 1, "model").alias("line")
    )
    return head.unionByName(models).orderBy("at")


def prediction_distribution(
    judged: DataFrame, *, split: str = "split", prediction: str = "prediction"
) -> DataFrame:
    """Per predicted label its count and share in both splits, side by side."""

    def inside(name: str) -> Column:
        return F.count_if(F.col(split) == name)

    splits = ("train", "val")
    counts = judged.groupBy(F.col(prediction).alias("prediction")).agg(
        *[inside(n).alias(f"{n}_count") for n in splits]
    )
    sums = [F.sum(f"{n}_count").alias(n) for n in splits]
    totals = counts.agg(F.struct(*sums).alias("n")).scalar()

    def percent(name: str) -> Column:
        share = F.try_divide(F.col(f"{name}_count") * 100.0, F.col("totals")[name])
        return F.round(F.coalesce(share, F.lit(0.0)), 1).alias(f"{name}_pct")

    return (
        counts.withColumn("totals", totals)
        .select("*", *[percent(n) for n in splits])
        .drop("totals")
    )


def failed_cases(
    judged: DataFrame, k: int = 5, *, by: str = "split", order: str = "sample_id"
) -> DataFrame:
    """The first ``k`` wrong samples of each split. The rank limit is applied within tasks before
    the shuffle, so a split of any size sends ``k`` rows per task."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return judged.filter(~F.col("is_correct")).withColumn("rank", rank).filter(F.col("rank") <= k)


# --- tag F1 ----------------------------------------------------------------------------------


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(
        F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)
    )


def exact_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two tag sets: 1 when both are empty, 0 when one is."""
    n_pred, n_gold = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    common = F.size(F.array_intersect(predicted, gold))
    return F.when((n_pred == 0) & (n_gold == 0), 1.0).otherwise(
        _f1(
            F.coalesce(F.try_divide(common, n_pred), F.lit(0.0)),
            F.coalesce(F.try_divide(common, n_gold), F.lit(0.0)),
        )
    )


def unit_vector(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    as_double = F.transform(vector, lambda x: x.cast("double"))

    def scaled(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)

    return let(as_double, scaled)


def _near(a: Column, b: Column, threshold: float) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) >= threshold


def semantic_f1(
    records: DataFrame,
    tag_vectors: DataFrame,
    *,
    predicted: str = "predicted",
    gold: str = "gold",
    threshold: float = SEMANTIC_THRESHOLD,
) -> DataFrame:
    """``(sample_id, f1)``: a tag counts as matched when some tag of the other list is at least
    as near as the threshold. Sizes are those of the lists; a tag without a vector never matches.

    ``tag_vectors`` is ``(tag, vector)`` with unit vectors. Both lists of a record are looked up
    in one join and compared inside the record's row, so no pair of tags becomes a row.
    """
    def side(column: str, name: str) -> Column:
        return F.transform(
            column, lambda t: F.struct(F.lit(name).alias("side"), t.alias("tag"))
        )

    listed = records.select(
        "sample_id",
        F.size(predicted).alias("n_pred"),
        F.size(gold).alias("n_gold"),
        F.explode_outer(F.concat(side(predicted, "p"), side(gold, "g"))).alias("e"),
    ).select("sample_id", "n_pred", "n_gold", F.col("e.side").alias("side"), F.col("e.tag").alias("tag"))
    per_record = (
        listed.join(tag_vectors, "tag", "left")
        .groupBy("sample_id", "n_pred", "n_gold")
        .agg(
            F.collect_list(F.when(F.col("side") == "p", F.col("vector"))).alias("p"),
            F.collect_list(F.when(F.col("side") == "g", F.col("vector"))).alias("g"),
        )
    )

    def matched(these: str, those: str) -> Column:
        return F.size(
            F.filter(these, lambda a: F.exists(those, lambda b: _near(a, b, threshold)))
        )

    f1 = F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0).otherwise(
        _f1(
            F.coalesce(F.try_divide(matched("p", "g"), F.col("n_pred")), F.lit(0.0)),
            F.coalesce(F.try_divide(matched("g", "p"), F.col("n_gold")), F.lit(0.0)),
        )
    )
    return per_record.select("sample_id", f1.alias("f1"))


def f1_delta(scored: DataFrame, *, phase: str = "phase", f1: str = "f1") -> DataFrame:
    """Mean F1 before and after, and the gain, in one pass."""

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col(phase) == name, F.col(f1))), F.lit(0.0))

    return scored.agg(
        F.round(mean("before"), 6).alias("before_f1"),
        F.round(mean("after"), 6).alias("after_f1"),
        F.round(mean("after") - mean("before"), 6).alias("improvement"),
    )


def tagged_ratio(records: DataFrame, tags: str = "tags") -> DataFrame:
    tagged = F.count_if(F.coalesce(F.size(tags), F.lit(0)) > 0)
    return records.agg(
        F.count("*").alias("total"),
        tagged.alias("tagged"),
        F.round(F.coalesce(F.try_divide(tagged * 100.0, F.count("*")), F.lit(0.0)), 1).alias("pct"),
    )


def inference_summary(results: DataFrame, success: Column) -> DataFrame:
    """Samples, successes and the success rate in percent."""
    good = F.count_if(success)
    return results.agg(
        F.count("*").alias("total_samples"),
        good.alias("successful_samples"),
        F.round(F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)), 2).alias(
            "success_rate"
        ),
    )


def length_stats(
    samples: DataFrame, words: Column, max_words: int, by: Sequence[str] = ("split",)
) -> DataFrame:
    """Samples over the length limit and the average length per split."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(words > max_words).alias("truncated"),
        F.round(F.avg(words), 1).alias("avg_words"),
    )
