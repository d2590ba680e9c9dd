"""Learn tag-model scores on one split and route every sample with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagloom.operators.routing import (
    clean_matrix,
    route_report,
    route_samples,
    routed_scores,
    tag_scores_wide,
)
from tagloom.session import cut_lineage, small_side


def learn_scores(sample_tags: DataFrame, clean: DataFrame, models: Sequence[str]) -> DataFrame:
    """The score table, written once: one row per tag, read for every sample that is routed."""
    return small_side(cut_lineage(tag_scores_wide(sample_tags, clean, models)))


def route_all(sample_tags: DataFrame, matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """Report over all samples of the matrix, routed with the table learned from them."""
    clean = clean_matrix(matrix, models)
    scores = learn_scores(sample_tags, clean, models)
    routes = route_samples(sample_tags, scores, models)
    return route_report(routed_scores(clean, routes, models))


def route_by_split(
    sample_tags: DataFrame, matrix: DataFrame, models: Sequence[str], splits: DataFrame
) -> DataFrame:
    """Report per split; ``splits`` is ``(sample_id, split)`` and ``train`` teaches the table."""
    clean = clean_matrix(matrix, models)
    train = splits.filter(F.col("split") == "train")
    scores = learn_scores(sample_tags.join(train, "sample_id", "left_semi"), clean, models)
    routes = route_samples(sample_tags, scores, models)
    return route_report(routed_scores(clean, routes, models, splits), by=["split"])
