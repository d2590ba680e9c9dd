"""Text expressions shared by the extractors, parsers and prompt builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Everything a Unicode-aware strip removes; Spark's plain trim removes spaces only.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# A "word" character in the Unicode sense (Java's \w is ASCII).
WORD_CLASS = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return strip(or_empty(text)) == ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_strip(text: Column, sep: str) -> Column:
    """Pieces of ``text``, stripped, blanks dropped; ``sep`` is a plain character."""
    return F.filter(
        F.transform(F.split(or_empty(text), sep), strip),
        lambda piece: piece != "",
    )


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def head_words(text: Column, n: int) -> Column:
    """The first ``n`` space-separated words; spacing inside is kept."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def tail_words(text: Column, n: int) -> Column:
    """The last ``n`` space-separated words; spacing inside is kept."""
    return let(
        F.split(text, " "),
        lambda words: F.array_join(
            F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " "
        ),
    )


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for a blank text."""
    return F.when(is_blank(text), 0).otherwise(F.size(F.split(strip(text), r"\s+")))
