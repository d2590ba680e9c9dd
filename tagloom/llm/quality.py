"""Quality rules: a threshold table compiled into one projection.

Every rule bounds one number that is computed from the text alone, so the whole filter is a scan
and a projection of built-in functions: nothing is shuffled, joined or sent to Python.

Defined results: a NULL text has no words; an empty text has no words; both fail the length rule.
Rows are judged one by one, so repeated rows get equal verdicts. Further columns are kept, also
when they are named like a measure: measures live in one struct column of the caller's name, which
replaces a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.words import bound, words_of

# Frequent short words of the four languages.
STOP_WORDS = (
    "the of and to in is that for with as was on are by this be at from or an "
    "der die das und in zu den von mit sich ist nicht ein eine als auf für auch im es "
    "le la les de des et un une en du que dans est pour qui sur pas au avec par "
    "el los las del y se por con una su para como no lo al más o"
).split()
STOP_LANGUAGES = ("en", "de", "fr", "es")
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``least <= measure <= most``; a bound that is None doesn't hold anything back."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# The base rules decide ``base_failed``, all of them together ``kept``.
BASE_RULES = (
    Rule("few_words", "n_words", least=50),
    Rule("repeats", "repeat_ratio", most=0.5),
)
RULES = BASE_RULES + (
    Rule("too_long", "n_words", most=1_000_000),
    Rule("word_length", "mean_word", least=2.0, most=12.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("dup_lines", "dup_line_ratio", most=0.5),
)


def _starts(words: Column) -> Column:
    """Positions at which a 3-word window starts."""
    last = F.size(words) - 3
    none = F.array().cast("array<int>")
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)


def _windows(words: Column) -> Column:
    """The 3-word windows with their positions, sorted; none if no two of them are equal.

    Most texts repeat no window. Hashes tell at once that all windows differ; only the other texts
    build and sort the windows themselves.
    """
    hashes = F.transform(
        _starts(words),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    windows = F.transform(
        _starts(words),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"),
            i.alias("i"),
        ),
    )
    repeats = F.size(F.array_distinct(hashes)) < F.size(words) - 2
    none = F.array().cast("array<struct<w:string,i:int>>")
    return F.when(repeats, F.sort_array(windows)).otherwise(none)


def _covered(ordered: Column) -> Column:
    """Number of words in windows that occur twice or more, the first one included.

    Equal neighbours among the sorted windows are repeats. Their positions, sorted again, add up
    to the covered words: each adds three less what the one before it has covered.
    """
    same = lambda x, k: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
    starts = F.sort_array(
        F.transform(
            F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]
        )
    )
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"],
    )


def measures_of(text: Column) -> Column:
    """A struct of measures of a whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_stop``, ``n_lines`` (with a word),
    ``n_dup_lines`` (equal to an earlier line), ``n_repeat_words``, and the ratios of the rules.
    """
    whole = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def of_words(words: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(F.regexp_count(whole, F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop"),
            bound(_windows(words), _covered).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        )

    return bound(
        F.struct(
            bound(words_of(text), of_words).alias("w"),
            bound(F.filter(F.split(whole, "\n"), has_word), of_lines).alias("l"),
        ),
        lambda m: F.struct(
            *[m["w"][x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_stop")],
            *[m["l"][x].alias(x) for x in ("n_lines", "n_dup_lines")],
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            ratio(m["w"]["word_chars"], m["w"]["n_words"]).alias("mean_word"),
            ratio(m["w"]["n_symbols"], m["w"]["word_chars"]).alias("symbol_ratio"),
            ratio(m["w"]["n_stop"], m["w"]["n_words"]).alias("stop_ratio"),
            ratio(m["l"]["n_dup_lines"], m["l"]["n_lines"]).alias("dup_line_ratio"),
            ratio(m["w"]["n_repeat_words"], m["w"]["n_words"]).alias("repeat_ratio"),
        ),
    )


def passes(rules: tuple[Rule, ...], measures: Column) -> Column:
    """All rules as one boolean expression."""
    held = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            held &= measures[rule.measure] >= F.lit(rule.least)
        if rule.most is not None:
            held &= measures[rule.measure] <= F.lit(rule.most)
    return held


def failed_rules(rules: tuple[Rule, ...], measures: Column) -> Column:
    """The names of the rules that a document breaks, in table order."""
    return F.array_compact(
        F.array(*[F.when(~passes((rule,), measures), F.lit(rule.name)) for rule in rules])
    )


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", into: str = "measures"
) -> DataFrame:
    """``docs``, the measures, and ``<into>_failed``: the names of the broken rules."""
    measured = docs.withColumn(into, measures_of(F.col(text)))
    return measured.withColumn(f"{into}_failed", failed_rules(rules, F.col(into)))


def keep_good(
    docs: DataFrame,
    rules: tuple[Rule, ...] | None = None,
    *,
    text: str = "text",
    lang: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their own columns.

    By default these are all rules but ``too_long``, since length alone is no fault. Where ``lang``
    names a column of language codes, ``stop_words`` holds for the languages of the stop words only.
    """
    used = tuple(r for r in RULES if r.name != "too_long") if rules is None else rules
    if lang is None:
        return docs.filter(bound(measures_of(F.col(text)), lambda m: passes(used, m)))
    code = F.lower(F.regexp_extract(F.col(lang), "^[A-Za-z]*", 0))
    other = ~F.coalesce(code.isin(*STOP_LANGUAGES), F.lit(False))
    any_language = tuple(r for r in used if r.name != "stop_words")
    stop = tuple(r for r in used if r.name == "stop_words")
    return docs.filter(
        bound(measures_of(F.col(text)), lambda m: passes(any_language, m) & (other | passes(stop, m)))
    )
