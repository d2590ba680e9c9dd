"""Lexical keys and word n-grams of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tagloom.functions.text import WORD_CLASS, let

# Frequent English function words, left out of tag terms by default. The list is
# a parameter everywhere it is used.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers him his how if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our ours out over own same she should so "
    "some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your"
).split()


def words_of(text: Column) -> Column:
    """Words once everything but word characters and white space became a space."""
    spaced = F.regexp_replace(F.lower(text), rf"[^{WORD_CLASS}]+", " ")
    return F.filter(F.split(spaced, " "), lambda word: word != "")


def stem(word: Column) -> Column:
    """Suffix cut: -ing, else -ed, else a plural -s of a word longer than three letters."""
    size = F.length(word)
    return (
        F.when(F.endswith(word, F.lit("ing")), F.left(word, size - 3))
        .when(F.endswith(word, F.lit("ed")), F.left(word, size - 2))
        .when(F.endswith(word, F.lit("s")) & (size > 3), F.left(word, size - 1))
        .otherwise(word)
    )


def lexical_key(tag: Column) -> Column:
    """Lower-cased, punctuation-free, stemmed form under which variants of a tag meet."""
    stems = F.filter(F.transform(words_of(tag), stem), lambda word: word != "")
    return F.array_join(stems, " ")


def terms_of(tag: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two letters or more without stop words, and their neighbouring pairs."""
    found = F.regexp_extract_all(F.lower(tag), F.lit(rf"[{WORD_CLASS}]{{2,}}"), 0)
    stops = F.array(*[F.lit(word) for word in stop_words])
    kept = F.filter(found, lambda word: ~F.array_contains(stops, word))

    def with_pairs(words: Column) -> Column:
        rest = F.slice(words, 2, F.size(words))
        shorter = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        pairs = F.zip_with(shorter, rest, lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(words, pairs)

    return let(kept, with_pairs)
