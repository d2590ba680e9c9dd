"""Registered queries: limits and splits, batch inference, resumed and streamed work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import prompts as P
from tagloom.functions import responses as J
from tagloom.operators import inference as I
from tagloom.operators import sampling as L
from tagloom.operators.normalize import frequent_tags, rule_mapping, tag_frequency, tag_occurrences
from tagloom.plans.catalog_records import (
    EVALUATION_PROMPT,
    HEAD_TAIL,
    LONG_INPUTS,
    ROUTER_VIEWS,
    candidate_names,
    docs,
    filled,
    head,
    tagged_samples,
)
from tagloom.plans.catalog_tags import STRICT
from tagloom.plans.fixtures import table, view, with_views
from tagloom.plans.inference import evaluate_router, tag_long_contexts, tag_prompts
from tagloom.session import cut_lineage, scratch_path
from tagloom.streaming import jobs

LONG_TEXT = 2000


def head_limit(spark, sf):
    return L.head_limit(docs(spark, sf, "text"), 100, "sample_id")


def prefix_split(spark, sf):
    return L.prefix_split(docs(spark, sf, "source"), "sample_id", 0.2)


def sample_rows(spark, sf):
    return L.sample_rows(docs(spark, sf, "source"), 50, "sample_id", seed=7)


def shard_assign(spark, sf):
    return L.shard_assign(docs(spark, sf, "source"), "sample_id", 7)


def rule_tagger():
    """Stands in for a model: tags a text by its length and by a question mark."""

    def tag(texts: list[str]) -> list[str]:
        return [
            '[{"tag": "%s", "explanation": "size"}%s]'
            % (
                "long" if len(text) > LONG_TEXT else "short",
                ', {"tag": "question", "explanation": "mark"}' if "?" in text else "",
            )
            for text in texts
        ]

    return tag


def failing_tagger():
    """A model that cannot read long texts."""
    tag = rule_tagger()

    def guarded(texts: list[str]) -> list[str]:
        if any(len(text) > LONG_TEXT for text in texts):
            raise ValueError("text too long")
        return tag(texts)

    return guarded


def batch_infer(spark, sf):
    asked = docs(spark, sf, "text").select(
        "sample_id", P.tagging_prompt(F.col("text")).alias("full_input")
    )
    answered = I.batch_infer(asked, rule_tagger)
    return answered.select(
        "sample_id", F.array_join(J.tags_strict(F.col("raw_response")), "|").alias("tags"), "error"
    )


def batch_infer_errors(spark, sf):
    answered = I.batch_infer(
        docs(spark, sf, "text"), failing_tagger, text="text", retry_rows=True
    )
    return answered.select("sample_id", "raw_response", "error")


def tag_generation(spark, sf):
    """Prompts to tags through a model that fails on long inputs."""
    rows = docs(spark, sf, "text").withColumnRenamed("text", "prompt")
    tagged = tag_prompts(rows, failing_tagger, parse=J.tags_objects, retry_rows=True)
    return tagged.select(
        "sample_id", F.array_join(J.names_of(F.col("parsed_tags")), "|").alias("tags"), "success"
    )


def long_context_tags(spark, sf):
    rows = view(spark, sf, "fx_paths").withColumn("sources", F.array("source", "lang"))
    tagged = tag_long_contexts(rows, "path", rule_tagger)
    return tagged.select(
        "sample_id",
        "truncated_input",
        F.array_join(J.names_of(F.col("generated_tags")), "|").alias("tags"),
    )


def length_router():
    """Stands in for a router: names a model by the length of the question, cut at the brace."""

    def route(texts: list[str]) -> list[str]:
        return ['{"best_model": "m%02d"' % (len(text) % 11 + 1) for text in texts]

    return route


def router_evaluation(spark, sf):
    judged = evaluate_router(tagged_samples(spark, sf), candidate_names(spark, sf), length_router)
    return judged.select("sample_id", "prediction", "oracle", "is_correct")


def stream_tagging(spark, sf):
    """Answers arrive as files, are parsed and mapped by the vocabulary learned from them."""
    incoming = scratch_path(spark, "incoming")
    answers = view(spark, sf, "fx_responses").select("sample_id", "raw_response")
    answers.write.parquet(incoming)
    tags = answers.select("sample_id", J.tags_strict(F.col("raw_response")).alias("tags"))
    counts = tag_frequency(tag_occurrences(tags))
    mapping = cut_lineage(rule_mapping(frequent_tags(counts).select("tag")))
    tagged = jobs.run_tagging(
        spark,
        incoming,
        answers.schema,
        mapping,
        scratch_path(spark, "tagged"),
        scratch_path(spark, "progress"),
        parse=J.tags_strict,
    )
    return tagged.select("sample_id", "tags")


def stream_tag_once(spark, sf):
    """Files that repeat samples, read one at a time and in two runs: each sample is stored once."""
    incoming, progress = scratch_path(spark, "incoming"), scratch_path(spark, "progress")
    stored = scratch_path(spark, "tagged")
    seconds = F.timestamp_seconds(1_700_000_000 + F.col("sample_id") % 3600)
    answers = view(spark, sf, "fx_responses").select("sample_id", "raw_response", seconds.alias("ts"))
    tags = answers.select("sample_id", J.tags_strict(F.col("raw_response")).alias("tags"))
    mapping = cut_lineage(rule_mapping(frequent_tags(tag_frequency(tag_occurrences(tags))).select("tag")))
    for arriving in ("sample_id % 3 <> 0", "sample_id % 3 <> 1"):
        answers.where(arriving).coalesce(2).write.mode("append").parquet(incoming)
        tagged = jobs.run_tagging_once(
            spark,
            incoming,
            answers.schema,
            mapping,
            stored,
            progress,
            files_at_once=1,
            parse=J.tags_strict,
        )
    return tagged.select("sample_id", "tags")


def stream_vocabulary(spark, sf):
    """The frequent tags of a growing folder, each promoted once, over two runs."""
    incoming, progress = scratch_path(spark, "incoming"), scratch_path(spark, "progress")
    promoted = scratch_path(spark, "vocabulary")
    tags = view(spark, sf, "fx_tagged").select("sample_id", "tag")
    for arriving in ("sample_id % 4 = 0", "sample_id % 4 <> 0"):
        tags.where(arriving).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(tags.schema).parquet(incoming)
        vocabulary = jobs.run_to_files(jobs.running_vocabulary(stream, 20), promoted, progress)
    return vocabulary.select("tag")


def batch_infer_chunks(spark, sf):
    """Inference that stops after some chunks and is taken up again."""
    path = scratch_path(spark, "inference")
    asked = docs(spark, sf, "text").select(
        "sample_id", P.tagging_prompt(F.col("text")).alias("full_input")
    )
    settings = {"key": "sample_id", "chunks": 16, "at_once": 8}
    I.infer_in_chunks(asked, rule_tagger, path, most=8, **settings)
    answered = I.infer_in_chunks(asked, rule_tagger, path, budget=100_000, **settings)
    return answered.select(
        "sample_id", F.array_join(J.tags_strict(F.col("raw_response")), "|").alias("tags"), "error"
    )


def stream_tag_counts(spark, sf):
    """Event types as tags, counted per hour; only windows the watermark has closed."""
    schema = table(spark, sf, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tag"))
    )
    counts = jobs.run_to_files(
        jobs.windowed_tag_counts(events),
        scratch_path(spark, "counts"),
        scratch_path(spark, "progress"),
    )
    edges = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return counts.select(*edges, "tag", "n")


QUERIES = {
    f.__name__: f
    for f in (
        head_limit, prefix_split, sample_rows, shard_assign, batch_infer, batch_infer_errors,
        tag_generation, long_context_tags, router_evaluation, stream_tagging, stream_tag_once,
        stream_vocabulary, batch_infer_chunks, stream_tag_counts,
    )
}

_ANSWER_TAGS = f"SELECT sample_id, ({STRICT})[1:5] AS t FROM fx_responses"

ORACLES = {
    "head_limit": "SELECT doc_id AS sample_id, text FROM documents ORDER BY doc_id LIMIT 100",
    "sample_rows": """SELECT doc_id AS sample_id, source FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 50""",
    "prefix_split": """SELECT doc_id AS sample_id, source, CASE WHEN row_number() OVER (ORDER BY doc_id)
        <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'eval' END AS split FROM documents""",
    "shard_assign": """SELECT doc_id AS sample_id, source, CAST(least((row_number() OVER (ORDER BY doc_id) - 1)
        // (count(*) OVER () // 7), 6) AS INTEGER) AS shard FROM documents""",
    "batch_infer": f"""SELECT doc_id AS sample_id, CASE WHEN length(p) > {LONG_TEXT} THEN 'long' ELSE 'short' END ||
        CASE WHEN contains(p, '?') THEN '|question' ELSE '' END AS tags, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT doc_id, {filled(P.TAGGING_TEMPLATES['query_json'], query='text')} AS p FROM documents) t""",
    "batch_infer_errors": f"""SELECT doc_id AS sample_id, CASE WHEN length(text) > {LONG_TEXT} THEN 'Error' ELSE
          '[{{"tag": "short", "explanation": "size"}}' || CASE WHEN contains(text, '?')
            THEN ', {{"tag": "question", "explanation": "mark"}}' ELSE '' END || ']' END AS raw_response,
        CASE WHEN length(text) > {LONG_TEXT} THEN 'text too long' END AS error FROM documents""",
    "tag_generation": f"""SELECT doc_id AS sample_id, CASE WHEN length(p) > {LONG_TEXT} THEN 'Error' ELSE 'short' ||
          CASE WHEN contains(p, '?') THEN '|question' ELSE '' END END AS tags, length(p) <= {LONG_TEXT} AS success
        FROM (SELECT doc_id, {filled(P.TAGGING_TEMPLATES['query_json'], query=head(P.prompt_budget()))} AS p FROM documents) t""",
    "long_context_tags": f"""SELECT sample_id, text AS truncated_input,
          CASE WHEN length(p) > {LONG_TEXT} THEN 'long' ELSE 'short' END || CASE WHEN contains(p, '?') THEN '|question' ELSE '' END AS tags
        FROM (SELECT sample_id, text, {filled(P.TAGGING_TEMPLATES['query_json_inline'], query='text')} AS p FROM (
          SELECT sample_id, {HEAD_TAIL} AS text FROM (SELECT sample_id, inference_context AS text
            FROM ({LONG_INPUTS}) i) c) t) u""",
    "router_evaluation": with_views(
        f"""SELECT sample_id, prediction, oracle, prediction = oracle AS is_correct FROM (SELECT sample_id,
          'm' || lpad(CAST(length({EVALUATION_PROMPT}) % 11 + 1 AS VARCHAR), 2, '0') AS prediction FROM asked) p
        JOIN oracles USING (sample_id)""",
        **ROUTER_VIEWS,
    ),
    "stream_tagging": with_views(
        """SELECT sample_id, string_agg(tag, ',' ORDER BY i) AS tags FROM
          (SELECT sample_id, tag, min(i) AS i FROM listed JOIN often USING (tag) GROUP BY sample_id, tag) u GROUP BY sample_id""",
        answer_tags=_ANSWER_TAGS,
        listed="SELECT sample_id, unnest(t) AS tag, unnest(range(1, len(t) + 1)) AS i FROM answer_tags",
        often="SELECT tag FROM listed GROUP BY tag HAVING count(*) >= 20",
    ),
    "stream_vocabulary": with_views("SELECT tag FROM fx_tagged GROUP BY tag HAVING count(*) >= 20"),
    "stream_tag_counts": """
        SELECT h AS window_start, h + INTERVAL 1 HOUR AS window_end, event_type AS tag, count(*) AS n
        FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events) e
        WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
        GROUP BY h, event_type""",
}
ORACLES["stream_tag_once"] = ORACLES["stream_tagging"]
ORACLES["batch_infer_chunks"] = ORACLES["batch_infer"]
