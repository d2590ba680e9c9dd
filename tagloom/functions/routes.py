"""Router answers (free text) to model names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom.functions.jsontext import field_text, parse_document
from tagloom.functions.text import let, or_empty, split_strip, strip, strip_chars

GENERATION_ERROR = "GENERATION_ERROR"
NO_MODEL = "no_model_correct"

# Patterns and lead-in phrases a router answer may use.
FENCE_JSON = r"(?i)```json\s*"
FENCE = r"```\s*"
CLOSED_OBJECT = r'(?i)\{\s*"best_model"\s*:\s*"([^"]+)"\s*\}'
ANY_OBJECT = r'(?i)\{[^}]*"best_model"\s*:\s*"([^"]*)"[^}]*\}'
DOUBLE_QUOTED = r'(?i)"best_model"\s*:\s*"([^"]*)"'
SINGLE_QUOTED = r"(?i)'best_model'\s*:\s*'([^']*)'"
BARE_VALUE = r'(?i)best_model["\s]*:["\s]*([^",}\s]+)'
BARE_VALUE_LENIENT = r"(?i)best_model\s*:\s*([^\s,}]+)"
OPEN_VALUE = r'(?i)"best_model"\s*:\s*"([^"]*)'
LEAD_INS = ["The best model is:", "Answer:", "Model:", "The model is:"]
SKIPPED_LINE_STARTS = ["{", "}", '"best_model"']


def _group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL without a match (an empty group stays empty)."""
    matched = F.regexp_extract(text, pattern, 0) != ""
    return F.when(matched, F.regexp_extract(text, pattern, 1))


def _braced_document(text: Column) -> Column:
    """``best_model`` of the JSON object between the first and the last brace."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    has_both = (first > 0) & F.contains(text, F.lit("}")) & (last > first)
    span = F.when(has_both, F.substr(text, first, last - first + 1))
    return strip(field_text(parse_document(span), "best_model"))


def _unquoted(text: Column) -> Column:
    return strip_chars(strip(text), "\"'")


def route_single(text: Column) -> Column:
    """One model name as scored in evaluation; the error marker when nothing is found."""
    raw = or_empty(text)
    bare = strip(F.regexp_replace(F.regexp_replace(raw, FENCE_JSON, ""), FENCE, ""))

    def read(answer: Column) -> Column:
        loose = [
            F.nullif(_unquoted(_group(answer, pattern)), F.lit(""))
            for pattern in (DOUBLE_QUOTED, SINGLE_QUOTED, BARE_VALUE)
        ]
        return F.coalesce(
            strip(_group(answer, CLOSED_OBJECT)),
            _braced_document(answer),
            *loose,
            F.lit(GENERATION_ERROR),
        )

    return let(bare, read)


def route_lenient(text: Column) -> Column:
    """One model name as read during training; falls back to the first useful line."""
    raw = or_empty(text)

    def useful(line: Column) -> Column:
        skipped = F.lit(False)
        for start in SKIPPED_LINE_STARTS:
            skipped = skipped | F.startswith(line, F.lit(start))
        for phrase in LEAD_INS:
            line = F.when(
                F.startswith(line, F.lit(phrase)), strip(F.substr(line, F.lit(len(phrase) + 1)))
            ).otherwise(line)
        return F.when(skipped, F.lit("")).otherwise(strip_chars(line, "\"'.,"))

    lines = F.filter(F.transform(split_strip(raw, "\n"), useful), lambda line: line != "")
    return F.coalesce(
        strip(_group(raw, ANY_OBJECT)),
        _braced_document(raw),
        _unquoted(_group(raw, DOUBLE_QUOTED)),
        _unquoted(_group(raw, SINGLE_QUOTED)),
        _unquoted(_group(raw, BARE_VALUE_LENIENT)),
        F.try_element_at(lines, F.lit(1)),
        F.lit(""),
    )


def route_multi(text: Column) -> Column:
    """Every model named, in order; a missing closing quote is fine."""
    found = F.regexp_extract_all(or_empty(text), F.lit(OPEN_VALUE), 1)
    return F.filter(F.transform(found, strip), lambda model: model != "")
