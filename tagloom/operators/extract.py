"""Prompt extraction: one operator per source shape, plus tag edits on records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagloom.functions.text import is_blank, or_empty, strip

# Turns merged per task before the pieces of one conversation meet.
TURNS_PER_PIECE = 1024

TOXICITY_FIELDS = [
    "toxicity",
    "severe_toxicity",
    "identity_attack",
    "insult",
    "threat",
    "profanity",
    "sexually_explicit",
    "flirtation",
]
TOXICITY_THRESHOLD = 0.3

PROMPT_CANDIDATES = ["prompt", "instruction", "query", "text", "content"]

# Path keyword -> input fields to try; the first path part with a keyword decides, and within
# one part the keyword listed first.
LONG_CONTEXT_FIELDS = {
    "alce": ["question"],
    "infbench": ["input"],
    "json_kv": ["question"],
    "ruler": ["query", "question", "input"],
    "msmarco": ["query"],
    "multi_lexsum": ["sources"],
    "kilt": ["question"],
}
DEFAULT_INPUT_FIELDS = ["input"]


# --- single-row shapes -----------------------------------------------------------------------


def instruction_prompts(
    df: DataFrame, instruction: str, context: str, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Instruction, followed by its context when there is one."""
    head, tail = strip(or_empty(F.col(instruction))), strip(or_empty(F.col(context)))
    prompt = F.when(tail != "", F.concat(head, F.lit("\n\n"), tail)).otherwise(head)
    return df.filter(head != "").select(*keep, prompt.alias("prompt"))


def field_prompts(
    df: DataFrame, field: str, *, keep: Sequence[str] = (), with_tags: bool = False
) -> DataFrame:
    """One text field; ``with_tags`` adds an empty tag list."""
    extra = [F.array().cast("array<string>").alias("tags")] if with_tags else []
    prompt = strip(or_empty(F.col(field)))
    return df.filter(prompt != "").select(*keep, prompt.alias("prompt"), *extra)


def human_turns(
    turns: Column, *, role: str = "human", keep_blank: bool = False
) -> Column:
    """Stripped texts of one role from an ``ARRAY<STRUCT<from, value>>``."""
    spoken = F.filter(turns, lambda t: (t["from"] == role) & t["value"].isNotNull())
    texts = F.transform(spoken, lambda t: strip(t["value"]))
    return texts if keep_blank else F.filter(texts, lambda text: text != "")


def even_turns(turns: Column, *, keep_blank: bool = False) -> Column:
    """Stripped texts at even positions of an ``ARRAY<STRING>``: the user's side."""
    texts = F.transform(F.filter(turns, lambda _, i: i % 2 == 0), strip)
    return texts if keep_blank else F.filter(texts, lambda text: text != "")


def turn_prompts(
    df: DataFrame, texts: Column, *, sep: str = " ", keep: Sequence[str] = ()
) -> DataFrame:
    """One prompt per record from its list of user texts; records without any are dropped."""
    return df.filter(F.size(texts) > 0).select(*keep, F.array_join(texts, sep).alias("prompt"))


# --- long message tables ---------------------------------------------------------------------


def merge_turns(
    messages: DataFrame, key: str, order: str, text: Column, *, sep: str = " "
) -> DataFrame:
    """One prompt per conversation from a table with one row per message.

    Messages are joined in runs of ``TURNS_PER_PIECE`` first, so that the work for a very long
    conversation is spread over tasks and only finished pieces meet in its output row.
    """
    pieces = (
        messages.select(
            key,
            F.col(order).alias("at"),
            F.floor(F.col(order) / TURNS_PER_PIECE).alias("piece"),
            text.alias("part"),
        )
        .groupBy(key, "piece")
        .agg(F.expr(f"listagg(part, {_sql_text(sep)}) WITHIN GROUP (ORDER BY at)").alias("part"))
    )
    merged = F.expr(f"listagg(part, {_sql_text(sep)}) WITHIN GROUP (ORDER BY piece)")
    return pieces.groupBy(key).agg(merged.alias("prompt"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'") + "'"


def message_prompts(
    messages: DataFrame,
    *,
    key: str = "message_tree_id",
    order: str = "seq",
    role: str = "role",
    speaker: str = "prompter",
    text: str = "text",
    sep: str = " ",
    keep_blank: bool = False,
) -> DataFrame:
    """Merged texts of one speaker per conversation, in ``order``."""
    spoken = messages.filter((F.col(role) == speaker) & F.col(text).isNotNull())
    if not keep_blank:
        spoken = spoken.filter(~is_blank(F.col(text)))
    return merge_turns(spoken, key, order, strip(F.col(text)), sep=sep)


def positional_prompts(
    messages: DataFrame,
    *,
    key: str,
    position: str,
    text: str = "text",
    sep: str = " ",
    keep_blank: bool = False,
) -> DataFrame:
    """Merged texts at even positions per conversation."""
    spoken = messages.filter((F.col(position) % 2 == 0) & F.col(text).isNotNull())
    if not keep_blank:
        spoken = spoken.filter(~is_blank(F.col(text)))
    return merge_turns(spoken, key, position, strip(F.col(text)), sep=sep)


def conversation_stats(
    messages: DataFrame,
    *,
    key: str,
    role: str = "role",
    text: str = "text",
    user: str = "human",
    assistant: str = "gpt",
) -> DataFrame:
    """Conversations, those that yield a prompt, and non-blank turns by side, as one row.

    Turns are counted per conversation first, so nothing needs a distinct over messages.
    """
    spoken = ~is_blank(F.col(text))
    per_conversation = messages.groupBy(key).agg(
        F.count_if(spoken & (F.col(role) == user)).alias("user_turns"),
        F.count_if(spoken & (F.col(role) == assistant)).alias("assistant_turns"),
    )
    return per_conversation.agg(
        F.count("*").alias("conversations"),
        F.count_if(F.col("user_turns") > 0).alias("prompts"),
        F.coalesce(F.sum("user_turns"), F.lit(0)).alias("user_turns"),
        F.coalesce(F.sum("assistant_turns"), F.lit(0)).alias("assistant_turns"),
    )


# --- labels, tags, heterogeneous records -----------------------------------------------------


def label_tags(
    df: DataFrame,
    text: str,
    scores: Mapping[str, Column],
    *,
    threshold: float = TOXICITY_THRESHOLD,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Tags are the labels scored above the threshold, best first, ties in field order.

    Rows whose scores are all missing are dropped; rows with no label above keep an empty list.
    """
    scored = F.array(
        *[
            F.struct(score.cast("double").alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("n"))
            for i, (n, score) in enumerate(scores.items())
        ]
    )
    above = F.filter(scored, lambda s: s["score"] > threshold)
    tags = F.transform(F.sort_array(above, asc=False), lambda s: s["n"])
    known = F.coalesce(*[score.cast("double") for score in scores.values()]).isNotNull()
    prompt = strip(or_empty(F.col(text)))
    return df.filter((prompt != "") & known).select(
        *keep, prompt.alias("prompt"), tags.alias("tags")
    )


def add_tags(df: DataFrame, tags: Sequence[str], *, column: str = "tags") -> DataFrame:
    """Append fixed tags to every record; a repeated tag keeps its first place."""
    existing = F.coalesce(F.col(column), F.array().cast("array<string>"))
    added = F.array(*[F.lit(tag) for tag in tags])
    return df.withColumn(column, F.array_distinct(F.concat(existing, added)))


def first_text(
    df: DataFrame, candidates: Sequence[str] = PROMPT_CANDIDATES, *, blank_falls_back: bool = True
) -> Column:
    """The prompt of a record of unknown shape, NULL when there is none.

    The first candidate that is not empty decides. Without one, or with ``blank_falls_back`` when
    it is blank, the first text column in schema order that is not blank is taken.
    """
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates if c in df.columns]
    chosen = strip(F.coalesce(*present)) if present else F.lit(None).cast("string")
    strings = [F.nullif(strip(F.col(n)), F.lit("")) for n, t in df.dtypes if t == "string"]
    if blank_falls_back:
        return F.coalesce(F.nullif(chosen, F.lit("")), *strings)
    return F.nullif(F.coalesce(chosen, *strings), F.lit(""))


def record_prompts(
    df: DataFrame,
    *,
    candidates: Sequence[str] = PROMPT_CANDIDATES,
    blank_falls_back: bool = True,
    keep: Sequence[str] = (),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Prompts of records of unknown shape; ``drop`` names columns that are no text field."""
    fields = df.drop(*drop, *keep)
    prompt = first_text(fields, candidates, blank_falls_back=blank_falls_back)
    return df.select(*keep, prompt.alias("prompt")).filter(F.col("prompt").isNotNull())


def dataset_of(path: Column) -> Column:
    """Keyword of the dataset a file belongs to: of the first path part that holds one, and in
    it the keyword listed first. NULL for other files."""

    def keyword_in(part: Column) -> Column:
        found = F.lit(None).cast("string")
        for keyword in reversed(LONG_CONTEXT_FIELDS):
            found = F.when(F.contains(part, F.lit(keyword)), keyword).otherwise(found)
        return found

    parts = F.split(F.replace(F.lower(path), F.lit("\\"), F.lit("/")), "/")
    known = F.filter(F.transform(parts, keyword_in), lambda keyword: keyword.isNotNull())
    return F.try_element_at(known, F.lit(1))


def long_context_inputs(
    df: DataFrame,
    path: str | None,
    *,
    context: str = "context",
    input_fields: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``inference_context``: the input field of the record's dataset and its context.

    ``input_fields`` overrides the choice by path. Records without the field are dropped; a
    list of sources is joined by blank lines.
    """

    def text_of(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("string")
        is_list = isinstance(df.schema[name].dataType, T.ArrayType)
        return F.array_join(name, "\n\n") if is_list else F.col(name).cast("string")

    def first_of(names: Sequence[str]) -> Column:
        return F.coalesce(*[text_of(name) for name in names])

    if input_fields is not None:
        chosen = first_of(input_fields)
    else:
        chosen = first_of(DEFAULT_INPUT_FIELDS)
        for keyword, names in LONG_CONTEXT_FIELDS.items():
            chosen = F.when(F.col("_dataset") == keyword, first_of(names)).otherwise(chosen)
        df = df.withColumn("_dataset", dataset_of(F.col(path)))
    extra = or_empty(F.col(context))
    tail = F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise("")
    return (
        df.withColumn("_input", chosen)
        .filter(F.col("_input").isNotNull())
        .withColumn("inference_context", F.concat("_input", tail))
        .drop("_input", "_dataset")
    )
