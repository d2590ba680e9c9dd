"""Tagger answers (free text) to tag lists, as native expressions.

A tag with its reason is ``STRUCT<tag STRING, explanation STRING>``. Every parser returns an
array and never NULL. Character scans run once over the text, so a long answer stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom.functions.jsontext import field_text, items_of, parse_document
from tagloom.functions.text import (
    count_char,
    let,
    or_empty,
    split_strip,
    strip,
    strip_chars,
)

TAG_STRUCT = "struct<tag:string,explanation:string>"
MAX_TAGS = 5

# The patterns and fallback texts that decide which answers are recognised.
TAG_VALUE = r'"tag"\s*:\s*"([^"]+)"'
BRACKETED = r"\[[^\]]*\]"
BRACKETED_OR_BRACED = r"\[[^\]]*\]|\{[^}]*\}"
TAG_OBJECT = r'\{[^{}]*"tag"[^{}]*"explanation"[^{}]*\}'
LOOSE_TAG = r'"tag":\s*"([^"]*)"'
LOOSE_EXPLANATION = r'"explanation":\s*"([^"]*+(?:(?<=\\)"[^"\\]*+(?:\\.[^"\\]*+)*+)??)"\s*[,}]'
EXACT_TAG_OBJECT = r'\{"tag":\s*"([^"]+)",\s*"explanation":\s*"([^"]*)"\}'
GENERAL_TAG = ("General", "Unable to parse specific tags")
ERROR_TAG = ("Error", "Failed to parse JSON")


def _none(dtype: str) -> Column:
    return F.array().cast(f"array<{dtype}>")


def _pair(tag: Column, explanation: Column) -> Column:
    return F.struct(tag.alias("tag"), explanation.alias("explanation"))


def _fixed_pair(pair: tuple[str, str]) -> Column:
    return F.array(_pair(F.lit(pair[0]), F.lit(pair[1])))


def _first(tags: Column, cap: int | None) -> Column:
    return tags if cap is None else F.slice(tags, 1, cap)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _names(items: Column) -> Column:
    names = F.transform(items, lambda item: field_text(item, "tag"))
    return F.filter(names, lambda name: name.isNotNull())


def _explained(items: Column) -> Column:
    """Stripped pairs of the items that carry both fields."""
    pairs = F.transform(
        items, lambda item: _pair(field_text(item, "tag"), field_text(item, "explanation"))
    )
    usable = F.filter(pairs, lambda p: p["tag"].isNotNull() & p["explanation"].isNotNull())
    return F.transform(usable, lambda p: _pair(strip(p["tag"]), strip(p["explanation"])))


def _non_blank(names: Column) -> Column:
    return F.filter(F.transform(names, strip), lambda name: name != "")


def tags_basic(text: Column) -> Column:
    """JSON list when the answer starts with a bracket, else every quoted tag value."""
    text = or_empty(text)
    listed = F.when(
        F.startswith(strip(text), F.lit("[")), _names(items_of(parse_document(text)))
    )
    return F.slice(F.coalesce(listed, _all(text, TAG_VALUE, 1)), 1, MAX_TAGS)


def tags_strict(text: Column) -> Column:
    """JSON list or lone object, else quoted tag values; names are stripped, blanks dropped."""
    text = strip(or_empty(text))

    def read(document: Column) -> Column:
        lone = field_text(document, "tag")
        return F.coalesce(
            _names(items_of(document)),
            F.when(lone.isNotNull(), F.array(lone)),
        )

    found = F.coalesce(let(parse_document(text), read), _all(text, TAG_VALUE, 1))
    return F.slice(_non_blank(found), 1, MAX_TAGS)


def tags_from_lines(text: Column, cap: int | None = MAX_TAGS) -> Column:
    """Line reading: ``...tag...: x`` opens a tag, ``...explanation...: y`` or any later line
    fills it. One fold over the lines; the state holds the open tag and what is done."""

    def unquoted(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))

    def after_colon(line: Column) -> Column:
        return unquoted(strip(F.substr(line, F.instr(line, ":") + 1)))

    def closed(state: Column) -> Column:
        complete = (state["tag"] != "") & (state["explanation"] != "")
        if cap is not None:
            complete = complete & (F.size(state["done"]) < cap)
        return F.when(
            complete,
            F.concat(state["done"], F.array(_pair(state["tag"], state["explanation"]))),
        ).otherwise(state["done"])

    def state_of(done: Column, tag: Column, explanation: Column) -> Column:
        return F.struct(done.alias("done"), tag.alias("tag"), explanation.alias("explanation"))

    def step(state: Column, line: Column) -> Column:
        labelled = F.contains(line, F.lit(":"))
        lowered = F.lower(line)
        opens = labelled & F.contains(lowered, F.lit("tag"))
        explains = labelled & F.contains(lowered, F.lit("explanation"))
        fills = (state["tag"] != "") & (state["explanation"] == "")
        return (
            F.when(opens, state_of(closed(state), after_colon(line), F.lit("")))
            .when(explains, state_of(state["done"], state["tag"], after_colon(line)))
            .when(fills, state_of(state["done"], state["tag"], unquoted(line)))
            .otherwise(state)
        )

    start = state_of(_none(TAG_STRUCT), F.lit(""), F.lit(""))
    done = F.aggregate(split_strip(text, "\n"), start, step, closed)
    return let(
        done, lambda tags: F.when(F.size(tags) > 0, tags).otherwise(_fixed_pair(GENERAL_TAG))
    )


def _last_list(text: Column) -> Column:
    """The items of the last bracketed span, NULL when there is none or it is no valid list."""
    return items_of(parse_document(F.try_element_at(_all(text, BRACKETED, 0), F.lit(-1))))


def tags_explained(text: Column) -> Column:
    """Last bracketed list; falls back to line reading when it yields nothing."""
    text = strip(or_empty(text))
    return let(
        F.slice(_explained(_last_list(text)), 1, MAX_TAGS),
        lambda tags: F.when(F.size(tags) > 0, tags).otherwise(tags_from_lines(text)),
    )


def tags_objects(text: Column, cap: int | None = MAX_TAGS) -> Column:
    """Last bracketed list, else separate objects, else line reading. ``cap=None`` keeps all."""
    text = or_empty(text)

    def separate(matches: Column) -> Column:
        parsed = F.transform(matches, parse_document)
        return F.when(F.size(matches) > 0, _explained(parsed))

    listed = _first(_explained(_last_list(text)), cap)
    objects = _first(let(_all(text, TAG_OBJECT, 0), separate), cap)
    return F.coalesce(listed, objects, tags_from_lines(text, cap))


def names_of(tags: Column) -> Column:
    return F.transform(tags, lambda t: t["tag"])


def tags_longest(text: Column) -> Column:
    """``STRUCT<tags, success>`` from the longest bracketed or braced span, else from a rebuilt
    list of loose tag/explanation values, else from the whole answer."""
    text = strip(or_empty(text))

    spans = _all(text, BRACKETED_OR_BRACED, 0)
    ranked = F.transform(
        spans, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))
    )
    longest = F.array_max(ranked)["s"]

    tags = _all(text, LOOSE_TAG, 1)
    explanations = _all(text, LOOSE_EXPLANATION, 1)
    rebuilt_items = F.zip_with(
        tags,
        explanations,
        lambda t, e: F.concat(
            F.lit('{"tag": "'), t, F.lit('", "explanation": "'), e, F.lit('"}')
        ),
    )
    rebuilt = F.when(
        (F.size(tags) > 0) & (F.size(tags) == F.size(explanations)),
        F.concat(F.lit("["), F.array_join(rebuilt_items, ", "), F.lit("]")),
    )
    # An invalid longest span, and an absent one, both lead on to the rebuilt list; once a
    # list was rebuilt the raw answer is no longer tried.
    document = F.coalesce(
        parse_document(longest),
        F.when(rebuilt.isNotNull(), parse_document(rebuilt)).otherwise(parse_document(text)),
    )

    def result(doc: Column) -> Column:
        items = F.coalesce(items_of(doc), F.array(doc))
        pairs = F.transform(
            items, lambda item: _pair(field_text(item, "tag"), field_text(item, "explanation"))
        )
        return F.struct(
            F.when(doc.isNull(), _fixed_pair(ERROR_TAG)).otherwise(pairs).alias("tags"),
            doc.isNotNull().alias("success"),
        )

    return let(document, result)


def tags_comma(text: Column) -> Column:
    return F.slice(split_strip(text, ","), 1, MAX_TAGS)


def tags_string(text: Column) -> Column:
    """Comma list with optional outer quotes, not capped."""
    return split_strip(strip_chars(strip(or_empty(text)), "\"'"), ",")


def balanced_prefix(text: Column) -> Column:
    """The text up to the bracket that closes its first one; NULL when none does.

    One fold over the pieces between closing brackets keeps the depth and the length read.
    """

    def state_of(depth: Column, read: Column, end: Column) -> Column:
        return F.struct(depth.alias("depth"), read.alias("read"), end.alias("end"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + count_char(piece, "[") - 1
        read = state["read"] + F.length(piece) + 1
        return F.when(state["end"] > 0, state).otherwise(
            state_of(depth, read, F.when(depth == 0, read).otherwise(0))
        )

    # The text behind the last closing bracket closes nothing, so it is left out.
    pieces = F.split(text, "]")
    closing = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    zero = F.lit(0)
    end = F.aggregate(closing, state_of(zero, zero, zero), step, lambda s: s["end"])
    return let(end, lambda e: F.when(e > 0, F.substr(text, F.lit(1), e)))


def braced_objects(text: Column, opening: str = '{"tag":') -> Column:
    """The balanced ``{...}`` spans that begin with ``opening``, left to right; stops at the
    first one that never closes. One fold over the pieces that start at a brace."""

    span = "struct<start:int,size:int>"

    def state_of(depth: Column, at: Column, start: Column, spans: Column) -> Column:
        return F.struct(
            depth.alias("depth"), at.alias("at"), start.alias("start"), spans.alias("spans")
        )

    def step(state: Column, piece: Column) -> Column:
        after = state["at"] + F.length(piece)
        outside = state["depth"] == 0
        opens = F.startswith(piece, F.lit(opening))
        depth = (
            F.when(outside, F.when(opens, 1).otherwise(0))
            .when(F.startswith(piece, F.lit("{")), state["depth"] + 1)
            .when(F.startswith(piece, F.lit("}")), state["depth"] - 1)
            .otherwise(state["depth"])
        )
        start = F.when(outside & opens, state["at"]).otherwise(state["start"])
        ends = ~outside & (depth == 0)
        found = F.struct(
            state["start"].alias("start"), (state["at"] + 1 - state["start"]).alias("size")
        )
        spans = F.when(ends, F.concat(state["spans"], F.array(found))).otherwise(state["spans"])
        return state_of(depth, after, start, spans)

    pieces = _all(text, r"[{}][^{}]*|[^{}]+", 0)
    start = state_of(F.lit(0), F.lit(1), F.lit(0), _none(span))
    spans = F.aggregate(pieces, start, step, lambda s: s["spans"])
    return F.transform(spans, lambda s: F.substr(text, s["start"], s["size"]))


def tags_evaluated(text: Column) -> Column:
    """Reading used when scoring a tagger: whole list, list prefix, exact objects, then any
    balanced object."""
    text = strip(or_empty(text))

    def pairs(items: Column) -> Column:
        read = F.transform(
            items, lambda item: _pair(field_text(item, "tag"), field_text(item, "explanation"))
        )
        return F.filter(read, lambda p: p["tag"].isNotNull())

    exact = F.zip_with(_all(text, EXACT_TAG_OBJECT, 1), _all(text, EXACT_TAG_OBJECT, 2), _pair)
    scanned = pairs(F.transform(braced_objects(text), parse_document))
    loose = let(exact, lambda found: F.when(F.size(found) > 0, found).otherwise(scanned))

    whole = pairs(items_of(parse_document(text)))
    prefix = balanced_prefix(text)
    from_prefix = F.when(
        prefix.isNotNull(),
        F.coalesce(pairs(items_of(parse_document(prefix))), _none(TAG_STRUCT)),
    )
    return F.when(
        F.startswith(text, F.lit("[")), F.coalesce(whole, from_prefix, loose)
    ).otherwise(loose)


def without_echo(raw: Column, full_input: Column) -> Column:
    """Drop the prompt a model repeated before its answer."""
    rest = strip(F.substr(raw, F.length(full_input) + 1))
    return F.when(F.startswith(raw, full_input), rest).otherwise(raw)


def tagging_succeeded(tags: Column) -> Column:
    """Has tags, and the first one is not the error marker."""
    return (F.size(tags) > 0) & (F.try_element_at(names_of(tags), F.lit(1)) != ERROR_TAG[0])
