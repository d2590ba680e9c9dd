"""What the operators of this subpackage share: words, row identity, block sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
NO_WORD = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), "")


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression.

    A filter on a computed column is pushed below its projection with the column's expression in
    place of the column, also inside lambdas, where it would be computed for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
