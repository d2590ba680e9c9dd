"""Schemas of the tables the jobs read and write, as DDL."""

from __future__ import annotations

from collections.abc import Sequence

from tagloom.functions.responses import TAG_STRUCT

PROMPTS = "sample_id long, prompt string"
TAGGED = "sample_id long, prompt string, tags array<string>"
# Stored tags as one comma-separated text.
TAGGED_TEXT = "sample_id long, prompt string, tags string"
TURN = "struct<from:string,value:string>"
DIALOGS = f"sample_id long, conversations array<{TURN}>"
POSITIONAL_DIALOGS = "sample_id long, conversations array<string>"
MESSAGES = "message_tree_id string, seq long, role string, text string"
ANSWERS = "sample_id long, raw_response string"
TAGGING_RESULTS = (
    "sample_id long, prompt string, full_input string, raw_response string, "
    f"parsed_tags array<{TAG_STRUCT}>, success boolean, error string"
)
OCCURRENCES = "sample_id long, pos long, tag string"
MAPPING = "tag string, canonical string"
CLEANED = "sample_id long, tags string"
ROUTING_SAMPLES = (
    "sample_id long, prompt string, eval_name string, tags array<string>, oracle string"
)
EVALUATED_SAMPLES = (
    ROUTING_SAMPLES + ", raw_generated_text string, prediction string, is_correct boolean, "
    "evaluation_timestamp string"
)


def score_matrix(models: Sequence[str]) -> str:
    """Wide matrix with one column per model."""
    return "sample_id long, prompt string, eval_name string, " + ", ".join(
        f"`{m}` double" for m in models
    )


def tag_scores(models: Sequence[str]) -> str:
    """Learned score table with one row per tag."""
    return "tag string, " + ", ".join(f"`{m}` double" for m in models)
