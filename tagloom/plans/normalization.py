"""The four normalization steps as one plan over tag occurrences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tagloom.operators.association import MIN_CONFIDENCE, MIN_SUPPORT, association_groups
from tagloom.operators.normalize import (
    MIN_TAG_COUNT,
    canonical_tags,
    compose,
    frequent_tags,
    rule_mapping,
    tag_frequency,
)
from tagloom.operators.similarity import MIN_SIMILARITY, semantic_groups
from tagloom.session import cut_lineage, small_side


@dataclass(frozen=True)
class Normalization:
    """Mappings ``(tag, canonical)`` after each step, from every frequent tag."""

    frequency: DataFrame
    rule: DataFrame
    semantic: DataFrame
    final: DataFrame

    def steps(self) -> dict[str, DataFrame]:
        return {
            "frequency": self.frequency,
            "rule": self.rule,
            "semantic": self.semantic,
            "association": self.final,
        }


def lexical_mapping(occurrences: DataFrame, min_count: int = MIN_TAG_COUNT) -> DataFrame:
    """Frequent tags mapped to the smallest tag with the same lexical key.

    Vocabulary and mapping are written once: occurrences are counted in a single pass, and the
    join that applies the mapping to them knows its size.
    """
    frequent = cut_lineage(frequent_tags(tag_frequency(occurrences), min_count).select("tag"))
    return small_side(cut_lineage(rule_mapping(frequent)))


def normalize_tags(
    occurrences: DataFrame,
    *,
    min_count: int = MIN_TAG_COUNT,
    min_similarity: float = MIN_SIMILARITY,
    min_support: int = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> Normalization:
    """Frequency filter, lexical, similarity and association grouping.

    Each mapping is vocabulary-sized and used by the next step and by the records, so it is
    written once instead of being computed again from the occurrences.
    """
    rule = lexical_mapping(occurrences, min_count)
    frequency = rule.select("tag", F.col("tag").alias("canonical"))
    semantic = cut_lineage(
        compose(rule, semantic_groups(canonical_tags(rule), min_similarity))
    )
    groups = association_groups(
        occurrences, small_side(semantic), min_support=min_support, min_confidence=min_confidence
    )
    final = small_side(cut_lineage(compose(semantic, groups)))
    return Normalization(frequency, rule, semantic, final)
