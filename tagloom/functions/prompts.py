"""Prompt building and truncation as string projections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tagloom.functions.jsontext import quoted
from tagloom.functions.routes import NO_MODEL
from tagloom.functions.text import head_words, or_empty, strip, tail_words

# The wording models were trained and prompted with; {query} marks the input.
TAGGING_TEMPLATES = {
    "intent_list": (
        "You are a tagging system that provides useful tags for instruction intentions to "
        "distinguish instructions for a helpful AI assistant. Below is an instruction: [begin] "
        "{query} [end] Please provide coarse-grained tags, such as \"Spelling and Grammar "
        "Check\" and \"Cosplay\", to identify main intentions of above instruction. Your answer "
        "should be a list including titles of tags and a brief explanation of each tag. Your "
        "response have to strictly follow this JSON format: [{\"tag\": str, \"explanation\": "
        "str}]. Please response in English."
    ),
    "query_json": (
        "You are a helpful assistant. Please identify tags of user intentions in the following "
        "user query and provide an explanation for each tag. Please respond in the JSON format "
        "{\"tag\": str, \"explanation\": str}.\n\nQuery: {query}\nAssistant:"
    ),
    "query_json_inline": (
        "You are a helpful assistant. Please identify tags of user intentions in the following "
        "user query and provide an explanation for each tag. Please respond in the JSON format "
        "{\"tag\": str, \"explanation\": str}. Query: {query} Assistant:"
    ),
    "query_plain": (
        "You are a helpful assistant. Please identify tags of user intentions in the following "
        "user query and provide an explanation for each tag. Query: {query} Assistant: "
    ),
    "ordered_facets": (
        "You are a helpful assistant. For the user query below, generate tags in this order:"
        "1) Domain, 2) Task Type, 3) Difficulty, 4) Language, 5) Topics (can be multiple). "
        "Explain each tag briefly. Output must be JSON: {\"tag\": str, \"explanation\": str}. "
        "Query: {query} Assistant:"
    ),
}
TRAINING_TEMPLATE = (
    "You are a helpful assistant. Please identify tags of user intentions in the following "
    "user query. Query: {query} Assistant: {response}"
)
TRAINING_JSON_TEMPLATE = (
    "You are a helpful assistant. For the user query below, generate tags in this order: "
    "1) Domain, 2) Task Type, 3) Difficulty, 4) Language, 5) Topics (can be multiple). "
    "Explain each tag briefly. Output must be JSON: {\"tag\": str, \"explanation\": str}. "
    "Query: {query} Assistant: {response}"
)
ROUTER_TEMPLATE = (
    "You are a model selector. Choose ONLY the model name from this list: {candidates}\n\n"
    "{pad}For the task: {task}\n{pad}Tags: {tags}\n{pad}Question: {query}\n\n"
    "{pad}Respond in JSON format:\n        {\"best_model\": \"\"}"
)
ROUTER_MULTI_TEMPLATE = (
    "You are a model selector. Choose the {emphasis}best model(s){emphasis} from this list: "
    "{candidates}\n\n"
    "{pad}For the task: {task}\n{pad}Tags: {tags}\n{pad}Question: {query}\n\n"
    "{pad}You can select multiple models if they are equally good. For each selected model, "
    "output a separate JSON object:\n"
    "{pad}{\"best_model\": \"model_name\"}\n"
    "{pad}If multiple models are good, output like: {\"best_model\": \"model1\"} "
    "{\"best_model\": \"model2\"}\n\n"
    "{pad}IMPORTANT: If NO model from the list is suitable for this task, output:\n"
    "{pad}{\"best_model\": \"no_model_correct\"}"
)
END_OF_TEXT = "</s>"
ELISION = "\n\n[...]\n\n"
ROUTER_PROMPT_CHARS = 1800
CONTEXT_WORDS = 600
CHARS_PER_WORD = 4
MODEL_WORDS = 2048
ANSWER_WORDS = 150
MAX_TRAINING_TAGS = 5


def fill(template: str, **fields: Column | str) -> Column:
    """The template with each ``{name}`` replaced, as one concat."""
    parts: list[str | Column] = [template]
    for name, value in fields.items():
        marker = "{" + name + "}"
        next_parts: list[str | Column] = []
        for part in parts:
            if isinstance(part, str):
                for i, text in enumerate(part.split(marker)):
                    if i:
                        next_parts.append(value)
                    next_parts.append(text)
            else:
                next_parts.append(part)
        parts = next_parts
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def tagging_prompt(query: Column, template: str = "query_json") -> Column:
    return fill(TAGGING_TEMPLATES[template], query=or_empty(query))


# Fixed value: the turn marks around a prompt when a model's own chat template isn't at hand.
CHAT_TEMPLATE = "<bos><start_of_turn>user\n{query}<end_of_turn>\n<start_of_turn>model\n"


def chat_prompt(query: Column, template: str = "query_json") -> Column:
    """The tagging prompt as one user turn."""
    return fill(CHAT_TEMPLATE, query=tagging_prompt(query, template))


def prompt_text(prompt: Column, kind: T.DataType) -> Column:
    """A prompt as text; the parts of a list prompt are joined by a space."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(prompt, lambda part: part.cast("string")), " ")
    return prompt.cast("string")


def router_prompt(
    candidates: Column,
    task: Column,
    prompt: Column,
    tags: Column,
    *,
    training: bool = False,
    multi: bool = False,
) -> Column:
    """Router question. ``candidates`` is the sorted, comma-joined model list; without tags the
    training form says N/A where the evaluation form stays empty."""
    joined = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")
    no_tags = "N/A" if training else ""
    return fill(
        ROUTER_MULTI_TEMPLATE if multi else ROUTER_TEMPLATE,
        pad="        " if training else "    ",
        emphasis="**" if training else "",
        candidates=candidates,
        task=F.coalesce(task, F.lit("N/A")),
        tags=F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, joined).otherwise(no_tags),
        query=F.left(or_empty(prompt), F.lit(ROUTER_PROMPT_CHARS)),
    )


def _route_object(model: Column) -> Column:
    return F.concat(F.lit('{"best_model": "'), model, F.lit('"}'))


def router_target(oracle: Column) -> Column:
    return F.concat(F.lit(" "), _route_object(oracle))


def router_target_multi(models: Column) -> Column:
    """One object per ground-truth model, or the no-model marker."""
    named = F.when(F.size(models) > 0, models).otherwise(F.array(F.lit(NO_MODEL)))
    return F.concat(F.lit(" "), F.array_join(F.transform(named, _route_object), " "))


def training_text(prompt: Column, tags: Column, end: str = END_OF_TEXT) -> Column:
    """Tagger training text from the first five tags, blanks among them left out."""
    first = F.transform(F.slice(tags, 1, MAX_TRAINING_TAGS), strip)
    kept = F.array_join(F.filter(first, lambda tag: tag != ""), ", ")
    return F.concat(fill(TRAINING_TEMPLATE, query=prompt, response=kept), F.lit(end))


def tags_json(tags: Column) -> Column:
    """Tag structs as JSON with a space after commas and colons."""
    objects = F.transform(
        tags,
        lambda t: F.concat(
            F.lit('{"tag": '),
            quoted(t["tag"]),
            F.lit(', "explanation": '),
            quoted(t["explanation"]),
            F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(objects, ", "), F.lit("]"))


def training_json_text(
    prompt: Column, tags: Column, max_words: int = 1800, end: str = END_OF_TEXT
) -> Column:
    return fill(
        TRAINING_JSON_TEMPLATE,
        query=truncate_head(prompt, max_words),
        response=F.concat(tags_json(tags), F.lit(end)),
    )


def truncate_head(text: Column, max_words: int) -> Column:
    """The text, cut to its first ``max_words`` words when longer."""
    return F.when(F.size(F.split(text, " ")) > max_words, head_words(text, max_words)).otherwise(
        text
    )


def prompt_budget(template: str = "query_json") -> int:
    """Words left for the query once the template and the answer are reserved."""
    fixed = len(TAGGING_TEMPLATES[template].replace("{query}", "").split(" "))
    return MODEL_WORDS - ANSWER_WORDS - fixed


def truncate_head_tail(text: Column, max_words: int = CONTEXT_WORDS) -> Column:
    """Beginning and end of a long text around an elision mark; short texts stay whole."""
    half = max_words // 2
    chars = half * CHARS_PER_WORD
    head = head_words(F.left(text, F.lit(chars)), half)
    tail = tail_words(F.right(text, F.lit(chars)), half)
    return F.when(F.length(text) <= 2 * chars, text).otherwise(
        F.concat(head, F.lit(ELISION), tail)
    )
