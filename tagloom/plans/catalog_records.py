"""Registered queries: sources, sinks, extraction, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tagloom.functions import prompts as P
from tagloom.functions.text import WHITESPACE, word_count
from tagloom.operators import extract as E
from tagloom.operators import evaluation as V
from tagloom.operators import resume, routing as R
from tagloom.plans.fixtures import MODELS, table, view, with_views
from tagloom.session import scratch_path
from tagloom.sources import records as S
from tagloom.sources import sinks as K

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
DOCS_PER_FILE = 64
FIXED_TAGS = ["privacy", "personally identifiable information"]


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), *(columns or ("text", "lang", "source"))
    )


def doc_lines() -> Column:
    return F.split("text", "\n")


def doc_dialog() -> Column:
    """The lines of a document as turns of a conversation, human first."""
    return F.transform(
        doc_lines(),
        lambda line, i: F.struct(
            F.when(i % 2 == 0, "human").otherwise("gpt").alias("from"), line.alias("value")
        ),
    )


# --- sources ---------------------------------------------------------------------------------


def scan_records(spark, sf):
    rows = S.load_records(spark, f"{sf}/documents.parquet", DOC_SCHEMA)
    return rows.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("prompt"), "source")


def scan_with_source(spark, sf):
    root = scratch_path(spark, "tagged")
    named = docs(spark, sf, "source").withColumn("file", F.concat("source", F.lit("_tagged_total")))
    K.write_records(named.select("sample_id", "file"), root, partition_by=["file"])
    return S.load_with_source(spark, root, "sample_id long")


def scan_outcomes(spark, sf):
    """The files of each folder that could be read, and how many could not; one folder is damaged."""
    root = scratch_path(spark, "tagged")
    rows = docs(spark, sf, "source")
    K.write_records(rows.select("sample_id", F.col("source").alias("file")), root, partition_by=["file"])
    rows.coalesce(1).select(F.col("source").alias("value")).write.text(f"{root}/file=damaged")
    return (
        S.file_outcomes(spark, root, "sample_id long", pattern="part-*")
        .groupBy("source")
        .agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
            F.count_if(F.col("error").isNotNull()).alias("n_damaged"),
        )
    )


def standardize_tagged(spark, sf):
    rows = S.standardize_tagged(view(spark, sf, "fx_tag_text"))
    return rows.select("sample_id", F.array_join("tags", "|").alias("tags"))


def scan_json_array(spark, sf):
    root = scratch_path(spark, "json_array")
    blocks = (
        table(spark, sf, "documents")
        .groupBy(F.expr(f"doc_id div {DOCS_PER_FILE}").alias("block"))
        .agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("value"))
    )
    blocks.select("value").write.option("maxRecordsPerFile", 1).text(root)
    return S.read_json_array(spark, root, "doc_id long, text string, lang string")


def scan_jsonl(spark, sf):
    root = scratch_path(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.json(root)
    return S.read_json_lines(spark, root, "doc_id long, text string, lang string")


def scan_recursive(spark, sf):
    root = scratch_path(spark, "tree")
    table(spark, sf, "documents").select("doc_id", "lang").write.partitionBy("lang").json(root)
    rows = S.read_json_tree(spark, root, "doc_id long")
    return rows.select(S.entry_below(F.col("file_path"), S.resolved_path(spark, root)).alias("folder"), "doc_id")


def scan_permissive(spark, sf):
    """Good records and malformed lines of files that also hold blank lines."""
    root = scratch_path(spark, "permissive")
    line = F.to_json(F.struct("doc_id", "text"))
    lines = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 13 == 0, F.left(line, F.lit(12)))
        .when(F.col("doc_id") % 17 == 0, "")
        .otherwise(line)
        .alias("value")
    )
    lines.write.text(root)
    rows = S.read_json_checked(spark, root, T.StructType(DOC_SCHEMA.fields[:2]))
    bad = F.col(S.CORRUPT).isNotNull()
    return rows.select(
        F.when(bad, "bad").otherwise("good").alias("status"),
        F.when(~bad, F.col("doc_id")).alias("doc_id"),
        F.coalesce(F.when(~bad, F.col("text")), F.col(S.CORRUPT)).alias("content"),
    )


def _with_extension(spark, root: str, extension: str) -> str:
    """Gives text files just written another extension."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        path = status.getPath()
        if path.getName().endswith(".txt"):
            renamed = path.getName().removesuffix(".txt") + extension
            system.rename(path, spark._jvm.org.apache.hadoop.fs.Path(folder, renamed))
    return root


def scan_mixed_folder(spark, sf):
    """One folder with files of a record a line, some lines cut off, and files of one array each."""
    root = scratch_path(spark, "mixed")
    rows = table(spark, sf, "documents")
    line = F.to_json(F.struct("doc_id", "text"))
    rows.where("doc_id % 2 = 0").select(
        F.when(F.col("doc_id") % 13 == 0, F.left(line, F.lit(12))).otherwise(line).alias("value")
    ).write.text(f"{root}/lines")
    blocks = (
        rows.where("doc_id % 2 <> 0")
        .groupBy(F.expr(f"doc_id div {DOCS_PER_FILE}").alias("block"))
        .agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    )
    blocks.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/arrays")
    _with_extension(spark, f"{root}/lines", ".jsonl")
    _with_extension(spark, f"{root}/arrays", ".json")
    found = S.read_json_folder(spark, root, T.StructType(DOC_SCHEMA.fields[:2]))
    bad = F.col(S.CORRUPT).isNotNull()
    return found.select(
        F.regexp_extract("file_path", r"\.(\w+)$", 1).alias("kind"),
        F.when(bad, "bad").otherwise("good").alias("status"),
        F.when(~bad, F.col("doc_id")).alias("doc_id"),
        F.coalesce(F.when(~bad, F.col("text")), F.col(S.CORRUPT)).alias("content"),
    )


def cleaned_files(spark, sf):
    """Records written by source file and read again with the name of their file."""
    path = K.write_cleaned(
        view(spark, sf, "fx_paths").select("sample_id", "name"), scratch_path(spark, "cleaned"), "name"
    )
    return spark.read.schema("sample_id long, name string, file string").parquet(path)


def code_files(spark, sf):
    root = scratch_path(spark, "code")
    texts = table(spark, sf, "documents").select("text")
    K.write_single_texts(texts, root)
    return S.read_code_files(spark, root)


def coalesce_prompt(spark, sf):
    return E.record_prompts(view(spark, sf, "fx_mixed"), keep=["sample_id"])


def load_parsed(spark, sf):
    rows = docs(spark, sf).select(
        "sample_id",
        F.when(F.col("lang") != "de", F.col("text")),
        F.when(F.col("source") != "src3", F.col("source")),
    )
    return S.parsed_records(rows, positional=True)


def scores_long(spark, sf):
    clean = R.clean_matrix(view(spark, sf, "fx_scores"), MODELS)
    return R.scores_long(clean, MODELS)


# --- sinks -----------------------------------------------------------------------------------


def sink_roundtrip(spark, sf):
    path = K.write_records(
        docs(spark, sf), scratch_path(spark, "records"), partition_by=["lang"]
    )
    return S.load_records(spark, path, "sample_id long, text string, source string, lang string")


def version_roundtrip(spark, sf):
    """Two versions beside each other: the first one stays as it was."""
    path = scratch_path(spark, "versions")
    K.write_version(docs(spark, sf).where("sample_id % 2 = 0"), path, "v1")
    K.write_version(docs(spark, sf), path, "v2")
    rows = spark.read.parquet(path)
    return rows.select("version", "sample_id", "text", "source", "lang")


def append_once(spark, sf):
    """Results that come twice, and again in a second run, are stored once."""
    path = scratch_path(spark, "appended")
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    half = rows.filter(F.col("doc_id") % 2 == 0)
    resume.append_once(half.unionByName(half), path, "doc_id")
    return resume.append_once(rows, path, "doc_id")


def merge_files(spark, sf):
    paths = [scratch_path(spark, name) for name in ("documents", "benchmark")]
    for path, key in zip(paths, ("doc_id", "item_id"), strict=True):
        name = "documents" if key == "doc_id" else "benchmark"
        table(spark, sf, name).select(F.col(key).alias("id"), "text").write.json(path)
    return S.read_json_lines(spark, paths, "id long, text string")


def clean_output_names(spark, sf):
    return view(spark, sf, "fx_paths").select(
        "sample_id", "name", K.clean_name(F.col("name")).alias("clean")
    )


def mirror_output_names(spark, sf):
    place = K.mirror_names(F.col("path"), "/data")
    return view(spark, sf, "fx_paths").select("sample_id", "path", place.alias("p")).select(
        "sample_id", "path", "p.rel_dir", "p.base"
    )


def csv_flatten(spark, sf):
    path = scratch_path(spark, "csv")
    K.write_csv_preview(
        docs(spark, sf).select("sample_id", "text", F.array("source", "lang").alias("tags")), path
    )
    reader = spark.read.schema("sample_id long, text string, tags string")
    return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def resume_pending(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    return resume.pending(docs(spark, sf, "source"), done, "sample_id")


def merge_shards(spark, sf):
    shards = [("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html")]
    merged = None
    for name, key, text in shards:
        rows = E.field_prompts(table(spark, sf, name).withColumnRenamed(key, "id"), text, keep=["id"])
        rows = rows.withColumn("shard", F.lit(name))
        merged = rows if merged is None else merged.unionByName(rows)
    return merged


# --- extraction ------------------------------------------------------------------------------


def prompt_instruction(spark, sf):
    rows = docs(spark, sf).withColumn(
        "input",
        F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).otherwise("  "),
    )
    return E.instruction_prompts(rows, "text", "input", keep=["sample_id"])


def prompt_single_field(spark, sf):
    rows = E.field_prompts(docs(spark, sf), "text", keep=["sample_id"], with_tags=True)
    return rows.select("sample_id", "prompt", F.size("tags").alias("n_tags"))


def prompt_conversation(spark, sf):
    return E.turn_prompts(docs(spark, sf, "text"), E.human_turns(doc_dialog()), keep=["sample_id"])


def prompt_conversation_keep_blank(spark, sf):
    texts = E.human_turns(doc_dialog(), keep_blank=True)
    return E.turn_prompts(docs(spark, sf, "text"), texts, keep=["sample_id"])


def prompt_even_turns_newline(spark, sf):
    texts = E.even_turns(doc_lines(), keep_blank=True)
    return E.turn_prompts(docs(spark, sf, "text"), texts, sep="\n", keep=["sample_id"])


def prompt_even_turns(spark, sf):
    texts = E.even_turns(doc_lines())
    rows = docs(spark, sf, "text").withColumn("user_turns", F.size(texts))
    return E.turn_prompts(rows, texts, keep=["sample_id", "user_turns"])


def prompt_message_tree(spark, sf):
    return E.message_prompts(
        view(spark, sf, "fx_messages"), key="conv_id", order="turn", speaker="user"
    )


def prompt_positional_messages(spark, sf):
    return E.positional_prompts(
        view(spark, sf, "fx_messages"), key="conv_id", position="turn", sep="\n", keep_blank=True
    )


def conversation_stats(spark, sf):
    return E.conversation_stats(
        view(spark, sf, "fx_messages"), key="conv_id", user="user", assistant="assistant"
    )


def labels_to_tags(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "sample_id")
    rows = docs(spark, sf, "text").join(labels, "sample_id", "left")
    tagged = E.label_tags(
        rows, "text", {"quality": F.col("quality"), "toxic": F.col("toxic")}, keep=["sample_id"]
    )
    return tagged.withColumn("tags", F.array_join("tags", "|"))


def add_tags(spark, sf):
    own = F.array("source", F.when(F.col("lang") == "en", FIXED_TAGS[1]).otherwise(F.col("lang")))
    rows = docs(spark, sf).select("sample_id", own.alias("tags"))
    return E.add_tags(rows, FIXED_TAGS).withColumn("tags", F.array_join("tags", "|"))


def long_context_input(spark, sf):
    rows = view(spark, sf, "fx_paths").withColumn("sources", F.array("source", "lang"))
    return E.long_context_inputs(rows, "path").select("sample_id", "inference_context")


# --- prompts ---------------------------------------------------------------------------------


def tagging_prompt(spark, sf):
    return docs(spark, sf, "text").select(
        "sample_id", *[P.tagging_prompt(F.col("text"), name).alias(name) for name in P.TAGGING_TEMPLATES]
    )


def routing_samples(spark, sf):
    """The score matrix with record tags and the oracle model."""
    return view(spark, sf, "fx_scores").withColumn(
        "oracle", R.oracle_model(MODELS, "no_model_correct")
    )


def tagged_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Routing samples with the tags of their record; one task has none."""
    tags = F.when(F.col("eval_name") != "de", F.array("source", "eval_name"))
    return (
        routing_samples(spark, sf)
        .join(docs(spark, sf, "source"), "sample_id")
        .select("sample_id", "prompt", "eval_name", tags.alias("tags"), "oracle")
    )


def candidate_names(spark: SparkSession, sf: str) -> Column:
    """Sorted candidates in one text: at most one name per matrix column, so it is short."""
    names = F.expr("listagg(oracle, ', ') WITHIN GROUP (ORDER BY oracle)")
    models = routing_samples(spark, sf).select("oracle").distinct()
    return models.agg(names.alias("names")).scalar()


def chat_prompt(spark, sf):
    return docs(spark, sf).select("sample_id", P.chat_prompt(F.col("text")).alias("chat"))


def list_prompt(spark, sf):
    rows = docs(spark, sf).select("sample_id", F.split("text", " ").alias("prompt"))
    return rows.select("sample_id", P.prompt_text(F.col("prompt"), rows.schema["prompt"].dataType).alias("prompt"))


def router_prompt(spark, sf):
    rows = tagged_samples(spark, sf).withColumn("names", candidate_names(spark, sf))
    parts = [F.col(c) for c in ("names", "eval_name", "prompt", "tags")]
    return rows.select(
        "sample_id",
        P.router_prompt(*parts).alias("evaluation"),
        P.router_prompt(*parts, training=True).alias("training"),
        P.router_prompt(*parts, multi=True).alias("evaluation_multi"),
        P.router_prompt(*parts, training=True, multi=True).alias("training_multi"),
    )


def router_target(spark, sf):
    return routing_samples(spark, sf).select(
        "sample_id",
        P.router_target(F.col("oracle")).alias("target"),
        P.router_target_multi(R.ground_truth(MODELS)).alias("target_multi"),
    )


def training_text(spark, sf):
    tags = F.array("source", F.lit(" "), F.concat(F.lit(" "), "lang"), *[F.lit(t) for t in "abc"])
    return docs(spark, sf).select("sample_id", P.training_text(F.col("text"), tags).alias("text"))


def training_json_text(spark, sf):
    tags = F.array(
        F.struct(F.col("source").alias("tag"), F.lit('says "so"\n').alias("explanation")),
        F.struct(F.col("lang").alias("tag"), F.lit("é").alias("explanation")),
    )
    return docs(spark, sf).select(
        "sample_id", P.training_json_text(F.col("text"), tags).alias("text")
    )


def truncate_head_tail(spark, sf):
    return docs(spark, sf, "text").select(
        "sample_id", P.truncate_head_tail(F.col("text")).alias("truncated_input")
    )


def truncate_head(spark, sf):
    cut = P.truncate_head(F.col("text"), P.prompt_budget())
    return docs(spark, sf, "text").select("sample_id", P.tagging_prompt(cut).alias("full_input"))


def length_stats(spark, sf):
    rows = docs(spark, sf, "text").withColumn("split", split_of("sample_id"))
    return V.length_stats(rows.withColumn("words", word_count(F.col("text"))), F.col("words"), 512)


def split_of(key: str) -> Column:
    """Four fifths train, one fifth validation."""
    return F.when(F.col(key) % 5 < 4, "train").otherwise("val")


QUERIES = {
    f.__name__: f
    for f in (
        scan_records, scan_with_source, scan_outcomes, standardize_tagged, scan_json_array, scan_jsonl,
        scan_recursive, scan_permissive, scan_mixed_folder, cleaned_files, code_files, coalesce_prompt, load_parsed, scores_long,
        sink_roundtrip, clean_output_names, mirror_output_names, csv_flatten, resume_pending,
        merge_shards, prompt_instruction, prompt_single_field, prompt_conversation,
        prompt_conversation_keep_blank, prompt_even_turns_newline, prompt_even_turns,
        prompt_message_tree, prompt_positional_messages, conversation_stats, labels_to_tags,
        add_tags, long_context_input, tagging_prompt, chat_prompt, list_prompt, version_roundtrip,
        append_once, merge_files, router_prompt, router_target, training_text,
        training_json_text, truncate_head_tail, truncate_head, length_stats,
    )
}


# --- the same results in SQL -----------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ws(column: str) -> str:
    return f"trim({column}, {quote(WHITESPACE)})"


def filled(template: str, **fields: str) -> str:
    """A template as an SQL concatenation."""
    marked = quote(template)
    for name, sql in fields.items():
        marked = marked.replace("{" + name + "}", f"' || {sql} || '")
    return f"({marked})"


def _router(template: str, training: bool, query: str, tags: str) -> str:
    text = template.replace("{pad}", "        " if training else "    ")
    text = text.replace("{emphasis}", "**" if training else "")
    return filled(text, candidates="names", task="eval_name", tags=tags, query=query)


def models_long(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT sample_id, {i} AS pos, '{m}' AS model, {m} AS score FROM {source}"
        for i, m in enumerate(MODELS, 1)
    )


ORACLE_MODEL = (
    "SELECT sample_id, CASE WHEN max(score) > 0 THEN min_by(model, (-score, pos)) "
    "ELSE 'no_model_correct' END AS oracle FROM scores_l GROUP BY sample_id"
)
GROUND_TRUTH = """
SELECT sample_id, CASE WHEN count(*) FILTER (score = 1.0) > 0
         THEN list(model ORDER BY pos) FILTER (score = 1.0)
         ELSE coalesce((list(model ORDER BY score DESC, pos) FILTER (score > 0 AND score < 1))[1:3], []) END AS models
FROM scores_l GROUP BY sample_id"""
ROUTER_VIEWS = {
    "scores_l": models_long("fx_scores"),
    "oracles": ORACLE_MODEL,
    "asked": """SELECT doc_id AS sample_id, lang AS eval_name, left(text, 1800) AS q,
        CASE WHEN lang <> 'de' THEN source || ', ' || lang END AS tags,
        (SELECT string_agg(oracle, ', ' ORDER BY oracle) FROM (SELECT DISTINCT oracle FROM oracles) d) AS names
      FROM documents""",
}
EVALUATION_PROMPT = _router(P.ROUTER_TEMPLATE, False, "q", "coalesce(tags, '')")
_LINES = "string_split(text, chr(10))"


def _even(text: str) -> str:
    return (
        f"list_transform(list_filter({_LINES}, lambda x, i: i % 2 = 1), lambda x: {ws('x')})"
        if text == "all"
        else f"list_filter(list_transform(list_filter({_LINES}, lambda x, i: i % 2 = 1), "
        f"lambda x: {ws('x')}), lambda x: x <> '')"
    )


def _turn_oracle(texts: str, sep: str, extra: str = "") -> str:
    return (
        f"SELECT doc_id AS sample_id, {extra} array_to_string({texts}, {sep}) AS prompt "
        f"FROM documents WHERE len({texts}) > 0"
    )


_INPUT = """CASE WHEN lang = 'en' THEN question WHEN lang = 'fr' THEN coalesce(query, question, input)
 WHEN lang = 'de' THEN source || chr(10) || chr(10) || lang ELSE input END"""


def head(n: int) -> str:
    return f"array_to_string(list_slice(string_split(text, ' '), 1, {n}), ' ')"


HEAD_TAIL = """CASE WHEN length(text) <= 2400 THEN text ELSE
    array_to_string(list_slice(string_split(left(text, 1200), ' '), 1, 300), ' ')
    || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) ||
    array_to_string(list_slice(string_split(right(text, 1200), ' '), -300, -1), ' ') END"""
LONG_INPUTS = with_views(
    f"""SELECT sample_id, CASE WHEN context <> '' THEN i || chr(10) || chr(10) || context ELSE i END AS inference_context
    FROM (SELECT *, {_INPUT} AS i FROM fx_paths) t WHERE i IS NOT NULL"""
)

ORACLES = {
    "scan_records": "SELECT doc_id AS sample_id, text AS prompt, source FROM documents",
    "scan_with_source": "SELECT doc_id AS sample_id, source || '_tagged_total' AS source FROM documents",
    "scan_outcomes": """SELECT source, count(*) AS n_rows, 0 AS n_damaged FROM documents GROUP BY source
        UNION ALL SELECT 'damaged', 0, 1""",
    "standardize_tagged": with_views(
        f"""SELECT sample_id, array_to_string(list_filter(list_transform(string_split(
              trim({ws('tags')}, {quote(chr(34) + chr(39))}), ','), lambda x: {ws('x')}), lambda x: x <> ''), '|') AS tags
        FROM fx_tag_text WHERE prompt <> '' AND {ws('tags')} <> ''"""
    ),
    "scan_json_array": "SELECT doc_id, text, lang FROM documents",
    "scan_jsonl": "SELECT doc_id, text, lang FROM documents",
    "scan_recursive": "SELECT lang AS folder, doc_id FROM documents",
    "scan_permissive": """
        SELECT 'good' AS status, doc_id, text AS content FROM documents
        WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0
        UNION ALL
        SELECT 'bad', NULL, left('{"doc_id":' || doc_id || ',"text":"', 12) FROM documents
        WHERE doc_id % 13 = 0""",
    "code_files": f"SELECT {ws('text')} AS prompt FROM documents WHERE length({ws('text')}) > 10",
    "coalesce_prompt": with_views(
        f"""SELECT sample_id, prompt FROM (SELECT sample_id, coalesce(
          nullif({ws("coalesce(nullif(prompt, ''), nullif(instruction, ''), nullif(query, ''), nullif(content, ''), '')")}, ''),
          nullif({ws('prompt')}, ''), nullif({ws('instruction')}, ''), nullif({ws('query')}, ''),
          nullif({ws('content')}, ''), nullif({ws('title')}, '')) AS prompt FROM fx_mixed) t
        WHERE prompt IS NOT NULL"""
    ),
    "load_parsed": """SELECT doc_id AS "index", text AS prompt, source AS parsed_tags FROM documents
        WHERE lang <> 'de' AND source <> 'src3'""",
    "scores_long": with_views(models_long("fx_scores")),
    "sink_roundtrip": "SELECT doc_id AS sample_id, text, source, lang FROM documents",
    "scan_mixed_folder": """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'jsonl' ELSE 'json' END AS kind, 'good' AS status, doc_id, text AS content
        FROM documents WHERE doc_id % 26 <> 0
        UNION ALL
        SELECT 'jsonl', 'bad', NULL, left('{"doc_id":' || doc_id || ',"text":"', 12) FROM documents
        WHERE doc_id % 26 = 0""",
    "cleaned_files": with_views(
        r"""SELECT sample_id, name, regexp_replace(name, '(.)\.[^.]*$', '\1') || '_clean' AS file FROM fx_paths"""
    ),
    "clean_output_names": with_views(
        r"""SELECT sample_id, name, regexp_replace(name, '(.)\.[^.]*$', '\1') || '_clean' AS clean FROM fx_paths"""
    ),
    "mirror_output_names": with_views(
        """SELECT sample_id, path, CASE lang WHEN 'en' THEN 'alce_v1' WHEN 'fr' THEN 'ruler/x'
              WHEN 'de' THEN 'Multi_LexSum' ELSE 'other' END AS rel_dir,
           'part.' || source || '_results' AS base FROM fx_paths"""
    ),
    "csv_flatten": "SELECT doc_id AS sample_id, text, source || ', ' || lang AS tags FROM documents",
    "resume_pending": """SELECT doc_id AS sample_id, source FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "merge_shards": " UNION ALL ".join(
        f"SELECT '{t}' AS shard, {k} AS id, {ws(c)} AS prompt FROM {t} WHERE {ws(c)} <> ''"
        for t, k, c in (("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html"))
    ),
    "prompt_instruction": f"""SELECT doc_id AS sample_id, {ws('text')} ||
        CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || source ELSE '' END AS prompt
        FROM documents WHERE {ws('text')} <> ''""",
    "prompt_single_field": f"""SELECT doc_id AS sample_id, {ws('text')} AS prompt, 0 AS n_tags
        FROM documents WHERE {ws('text')} <> ''""",
    "prompt_conversation": _turn_oracle(_even("some"), "' '"),
    "prompt_conversation_keep_blank": _turn_oracle(_even("all"), "' '"),
    "prompt_even_turns_newline": _turn_oracle(_even("all"), "chr(10)"),
    "prompt_even_turns": _turn_oracle(_even("some"), "' '", f"CAST(len({_even('some')}) AS INTEGER) AS user_turns,"),
    "prompt_message_tree": with_views(
        f"""SELECT conv_id, string_agg({ws('text')}, ' ' ORDER BY turn) AS prompt FROM fx_messages
        WHERE role = 'user' AND {ws('text')} <> '' GROUP BY conv_id"""
    ),
    "prompt_positional_messages": with_views(
        f"""SELECT conv_id, string_agg({ws('text')}, chr(10) ORDER BY turn) AS prompt FROM fx_messages
        WHERE turn % 2 = 0 GROUP BY conv_id"""
    ),
    "conversation_stats": with_views(
        """SELECT count(*) AS conversations, count(*) FILTER (u > 0) AS prompts,
          CAST(sum(u) AS BIGINT) AS user_turns, CAST(sum(a) AS BIGINT) AS assistant_turns FROM (
          SELECT conv_id, count(*) FILTER (role = 'user' AND trim(text) <> '') AS u,
            count(*) FILTER (role = 'assistant' AND trim(text) <> '') AS a
          FROM fx_messages GROUP BY conv_id) t"""
    ),
    "labels_to_tags": f"""
        SELECT doc_id AS sample_id, {ws('text')} AS prompt, CASE
          WHEN quality > 0.3 AND toxic > 0.3 THEN CASE WHEN toxic > quality THEN 'toxic|quality' ELSE 'quality|toxic' END
          WHEN quality > 0.3 THEN 'quality' WHEN toxic > 0.3 THEN 'toxic' ELSE '' END AS tags
        FROM documents JOIN labels USING (doc_id)
        WHERE {ws('text')} <> '' AND (quality IS NOT NULL OR toxic IS NOT NULL)""",
    "add_tags": f"""SELECT doc_id AS sample_id, CASE WHEN lang = 'en'
        THEN source || '|{FIXED_TAGS[1]}|{FIXED_TAGS[0]}' ELSE source || '|' || lang || '|{'|'.join(FIXED_TAGS)}' END AS tags
        FROM documents""",
    "long_context_input": LONG_INPUTS,
    "tagging_prompt": "SELECT doc_id AS sample_id, "
    + ", ".join(f"{filled(t, query='text')} AS {n}" for n, t in P.TAGGING_TEMPLATES.items())
    + " FROM documents",
    "chat_prompt": f"SELECT doc_id AS sample_id, {filled(P.CHAT_TEMPLATE.replace('{query}', P.TAGGING_TEMPLATES['query_json']), query='text')} AS chat FROM documents",
    "list_prompt": "SELECT doc_id AS sample_id, text AS prompt FROM documents",
    "version_roundtrip": """
        SELECT 'v1' AS version, doc_id AS sample_id, text, source, lang FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT 'v2', doc_id, text, source, lang FROM documents""",
    "append_once": "SELECT doc_id, quality FROM labels",
    "merge_files": "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark",
    "router_prompt": with_views(
        f"""SELECT sample_id,
          {EVALUATION_PROMPT} AS evaluation,
          {_router(P.ROUTER_TEMPLATE, True, 'q', "coalesce(tags, 'N/A')")} AS training,
          {_router(P.ROUTER_MULTI_TEMPLATE, False, 'q', "coalesce(tags, '')")} AS evaluation_multi,
          {_router(P.ROUTER_MULTI_TEMPLATE, True, 'q', "coalesce(tags, 'N/A')")} AS training_multi
        FROM asked""",
        **ROUTER_VIEWS,
    ),
    "router_target": with_views(
        """SELECT sample_id, ' {"best_model": "' || oracle || '"}' AS target,
          ' ' || CASE WHEN len(models) = 0 THEN '{"best_model": "no_model_correct"}' ELSE
            array_to_string(list_transform(models, lambda m: '{"best_model": "' || m || '"}'), ' ') END AS target_multi
        FROM oracles JOIN truth USING (sample_id)""",
        scores_l=models_long("fx_scores"),
        oracles=ORACLE_MODEL,
        truth=GROUND_TRUTH,
    ),
    "training_text": "SELECT doc_id AS sample_id, "
    + filled(
        P.TRAINING_TEMPLATE + P.END_OF_TEXT, query="text", response="source || ', ' || lang || ', a, b'"
    )
    + " AS text FROM documents",
    "training_json_text": "SELECT doc_id AS sample_id, "
    + filled(
        P.TRAINING_JSON_TEMPLATE + P.END_OF_TEXT,
        query=head(1800),
        response="""'[{"tag": "' || source || '", "explanation": "says \\"so\\"\\n"}, {"tag": "' || lang || '", "explanation": "é"}]'""",
    )
    + " AS text FROM documents",
    "truncate_head_tail": f"SELECT doc_id AS sample_id, {HEAD_TAIL} AS truncated_input FROM documents",
    "truncate_head": "SELECT doc_id AS sample_id, "
    + filled(P.TAGGING_TEMPLATES["query_json"], query=head(P.prompt_budget()))
    + " AS full_input FROM documents",
    "length_stats": rf"""SELECT CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'val' END AS split, count(*) AS total,
        count(*) FILTER (w > 512) AS truncated, round(avg(w), 1) AS avg_words
        FROM (SELECT doc_id, len(string_split_regex({ws('text')}, '\s+')) AS w FROM documents) t GROUP BY 1""",
}
