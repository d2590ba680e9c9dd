"""Jobs around a model: tag prompts, tag long contexts, evaluate a router.

Each is one lazy plan: build the input text, run the model in ``mapInPandas``, read the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import responses as J
from tagloom.functions.prompts import (
    prompt_budget,
    router_prompt,
    tagging_prompt,
    truncate_head,
    truncate_head_tail,
)
from tagloom.functions.routes import GENERATION_ERROR, route_single
from tagloom.functions.text import strip
from tagloom.operators.evaluation import exact_match
from tagloom.operators.extract import long_context_inputs
from tagloom.operators.inference import Model, batch_infer

Parser = Callable[[Column], Column]


def _answer() -> Column:
    return J.without_echo(strip(F.col("raw_response")), F.col("full_input"))


def tag_prompts(
    prompts: DataFrame,
    model_factory: Callable[[], Model],
    *,
    template: str = "query_json",
    parse: Parser = J.tags_explained,
    **inference: object,
) -> DataFrame:
    """Tag every prompt: input text, answer, tags and whether it worked.

    ``prompts`` has ``prompt`` and any other columns. A prompt over the word budget is cut. A
    failed call is marked with the error tag; the job goes on.
    """
    cut = truncate_head(F.col("prompt"), prompt_budget(template))
    asked = prompts.withColumn("full_input", tagging_prompt(cut, template))
    answered = batch_infer(asked, model_factory, **inference)
    failed = F.col("error").isNotNull()
    mark = F.struct(
        F.lit(J.ERROR_TAG[0]).alias("tag"),
        F.concat(F.lit("Processing failed: "), "error").alias("explanation"),
    )
    return (
        answered.withColumn("parsed_tags", F.when(failed, F.array(mark)).otherwise(parse(_answer())))
        .withColumn("success", J.tagging_succeeded(F.col("parsed_tags")))
    )


def tag_long_contexts(
    records: DataFrame,
    path: str | None,
    model_factory: Callable[[], Model],
    *,
    template: str = "query_json_inline",
    parse: Parser = J.tags_objects,
    input_fields: Sequence[str] | None = None,
    **inference: object,
) -> DataFrame:
    """Tag long-context records: all their columns, then the cut input, tags and the answer.

    The input keeps its beginning and end. A failed call has no tags.
    """
    asked = (
        long_context_inputs(records, path, input_fields=input_fields)
        .withColumn("truncated_input", truncate_head_tail(F.col("inference_context")))
        .withColumn("full_input", tagging_prompt(F.col("truncated_input"), template))
    )
    answered = batch_infer(asked, model_factory, **inference)
    none = F.array().cast(f"array<{J.TAG_STRUCT}>")
    tags = F.when(F.col("error").isNull(), parse(_answer())).otherwise(none)
    return answered.withColumn("generated_tags", tags).drop("full_input")


def evaluate_router(
    samples: DataFrame,
    candidates: Column,
    model_factory: Callable[[], Model],
    *,
    oracle: str = "oracle",
    **inference: object,
) -> DataFrame:
    """Ask a router for every sample and judge its answer.

    ``samples`` has ``prompt``, ``eval_name``, ``tags`` and the oracle model; ``candidates`` is
    the sorted, comma-joined list of models.
    """
    question = router_prompt(candidates, F.col("eval_name"), F.col("prompt"), F.col("tags"))
    answered = batch_infer(samples.withColumn("full_input", question), model_factory, **inference)
    text = strip(F.col("raw_response"))
    prediction = F.when(F.col("error").isNull(), route_single(text)).otherwise(GENERATION_ERROR)
    return (
        answered.drop("full_input")
        .withColumn("raw_generated_text", text)
        .withColumn("prediction", prediction)
        .withColumn("is_correct", exact_match(F.col("prediction"), F.col(oracle)))
        .withColumn("evaluation_timestamp", F.current_timestamp().cast("string"))
        .drop("raw_response")
    )
