"""Derived views over the input tables, in SQL that Spark and the checking engine both read.

They give the base tables the shapes the operators work on: tagged records, a score matrix,
tagger and router answers in the formats models produce, messages, records of mixed shape.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

MODELS = [f"m{i:02d}" for i in range(1, 12)]


def _score(i: int) -> str:
    x = f"((doc_id*31 + {i}*17 + doc_id*{i}*7) % 11)"
    return (
        f"CASE WHEN doc_id % 10 = 0 THEN CAST(0 AS DOUBLE) "
        f"WHEN doc_id % 7 = 0 THEN ({x} % 4)*CAST(0.25 AS DOUBLE) "
        f"ELSE ({x} % 5)*CAST(0.25 AS DOUBLE) END AS m{i:02d}"
    )


_ANSWER = (
    """concat('[{"tag": "', source, '", "explanation": "e1"}, """
    """{"tag": "', lang, '", "explanation": "e2"}]')"""
)

# Name -> query; later views may use earlier ones.
VIEWS = {
    "fx_tagged": """
SELECT sample_id, place*10 AS pos, CASE variant WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
         WHEN 2 THEN replace(p_name, ' ', '-') ELSE concat(p_name, 's') END AS tag FROM fx_named
UNION ALL SELECT sample_id, place*10 + 1, p_brand FROM fx_named
UNION ALL SELECT sample_id, place*10 + 2, split_part(p_name, ' ', 2) FROM fx_named
UNION ALL SELECT l_orderkey, CAST(0 AS BIGINT), concat('rare ', CAST(l_orderkey % 1000 AS STRING))
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) o""",
    "fx_named": """
SELECT l_orderkey AS sample_id, CAST(l_linenumber AS BIGINT)*100000000000 + l_partkey AS place,
       l_linenumber % 4 AS variant, p_name, p_brand
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_scores": "SELECT doc_id AS sample_id, text AS prompt, lang AS eval_name,\n"
    + ",\n".join(_score(i) for i in range(1, 12))
    + "\nFROM documents",
    "fx_stags": """
SELECT doc_id AS sample_id, 1 AS pos, source AS tag FROM documents
UNION ALL SELECT doc_id, 2, lang FROM documents
UNION ALL SELECT doc_id, 3, concat('len ', CAST(n_chars % 7 AS STRING)) FROM documents""",
    "fx_responses": f"""
SELECT doc_id AS sample_id, source, lang, CASE doc_id % 8
 WHEN 0 THEN j
 WHEN 1 THEN concat('```json', chr(10), j, chr(10), '```')
 WHEN 2 THEN replace(replace(replace(j, '[', ''), ']', ''), '}}, {{', '}} {{')
 WHEN 3 THEN substring(j, 1, length(j) - 12)
 WHEN 4 THEN concat('Tag: ', source, chr(10), 'Explanation: e1', chr(10), 'Tag: ', lang, chr(10),
                    'Explanation: e2')
 WHEN 5 THEN concat(source, ', ', lang, ', , x')
 WHEN 6 THEN '' ELSE 'no structure here' END AS raw_response
FROM (SELECT doc_id, source, lang, {_ANSWER} AS j FROM documents) t""",
    "fx_predictions": """
SELECT doc_id AS sample_id, CASE doc_id % 8
 WHEN 0 THEN concat('{"best_model": "', m, '"}')
 WHEN 1 THEN concat('```json', chr(10), '{"best_model": "', m, '"}', chr(10), '```')
 WHEN 2 THEN concat('{''best_model'': ''', m, '''}')
 WHEN 3 THEN concat(' {"best_model": "', m, '"} {"best_model": "m01"}')
 WHEN 4 THEN concat('{"best_model": "', upper(m), '"')
 WHEN 5 THEN concat('The best model is: ', m, '.')
 WHEN 6 THEN ' {"best_model": "no_model_correct"}' ELSE '' END AS raw_generated_text
FROM (SELECT doc_id, concat('m', lpad(CAST(doc_id*5 % 11 + 1 AS STRING), 2, '0')) AS m
      FROM documents) t""",
    "fx_messages": """
SELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN '  ' ELSE concat(' ', text, ' ') END AS text
FROM conversations""",
    "fx_mixed": """
SELECT doc_id AS sample_id,
       CASE WHEN doc_id % 6 = 0 THEN text END AS prompt,
       CASE WHEN doc_id % 6 = 1 THEN concat(' ', text) ELSE '' END AS instruction,
       CASE WHEN doc_id % 6 = 2 THEN concat('  ', source, ' ') END AS query,
       CASE WHEN doc_id % 6 = 3 THEN '   ' END AS content,
       CASE WHEN doc_id % 6 IN (3, 4) THEN lang ELSE '' END AS title
FROM documents""",
    "fx_tag_text": """
SELECT doc_id AS sample_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS prompt,
       CASE doc_id % 5 WHEN 0 THEN concat('"', source, ', ', lang, '"')
         WHEN 1 THEN concat(source, ',', lang, ', ,x') WHEN 2 THEN ''
         WHEN 4 THEN concat('  ', source, ' ') END AS tags
FROM documents""",
    "fx_paths": """
SELECT doc_id AS sample_id,
       concat(source, CASE lang WHEN 'en' THEN '_tagged_total.pkl' ELSE '.data.pkl' END) AS name,
       concat('/data/', CASE lang WHEN 'en' THEN 'alce_v1' WHEN 'fr' THEN 'ruler/x'
              WHEN 'de' THEN 'Multi_LexSum' ELSE 'other' END, '/part.', source, '.jsonl') AS path,
       CASE WHEN doc_id % 3 > 0 THEN source END AS question,
       CASE WHEN doc_id % 4 > 0 THEN lang END AS input,
       CASE WHEN doc_id % 5 = 0 THEN concat('q ', source) END AS query,
       source, lang, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS context
FROM documents""",
}
_ORDER = ["fx_named", *[name for name in VIEWS if name != "fx_named"]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_tagged`` with one pass over the line items: all tags of a line leave its row."""
    lines = table(spark, sf_dir, "lineitem")
    place = F.col("l_linenumber").cast("long") * 100000000000 + F.col("l_partkey")
    name, variant = F.col("p_name"), F.col("l_linenumber") % 4
    spelled = (
        F.when(variant == 0, name)
        .when(variant == 1, F.upper(name))
        .when(variant == 2, F.replace(name, F.lit(" "), F.lit("-")))
        .otherwise(F.concat(name, F.lit("s")))
    )
    tags = (spelled, F.col("p_brand"), F.split_part(name, F.lit(" "), F.lit(2)))
    rows = F.array(
        *[F.struct((place * 10 + i).alias("pos"), tag.alias("tag")) for i, tag in enumerate(tags)]
    )
    named = lines.join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(F.col("l_orderkey").alias("sample_id"), F.inline(rows))
    rare = lines.select(F.col("l_orderkey").alias("sample_id")).distinct().select(
        "sample_id",
        F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit("rare "), (F.col("sample_id") % 1000).cast("string")).alias("tag"),
    )
    return named.unionByName(rare)


def sample_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_stags`` with one pass over the documents."""
    tags = ("source", "lang", F.concat(F.lit("len "), (F.col("n_chars") % 7).cast("string")))
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), (F.col(t) if isinstance(t, str) else t).alias("tag"))
            for i, t in enumerate(tags, 1)
        ]
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.inline(rows))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf_dir``."""
    for base in base_tables(name):
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(with_views(f"SELECT * FROM {name}"))


@cache
def base_tables(name: str) -> tuple[str, ...]:
    text = " ".join(VIEWS[v] for v in needed_views(f"FROM {name}"))
    return tuple(t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text))


def needed_views(sql: str) -> list[str]:
    wanted = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    while True:
        more = {v for w in wanted for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[w])}
        if more <= wanted:
            return [v for v in _ORDER if v in wanted]
        wanted |= more


def with_views(sql: str, *, recursive: bool = False, **extra: str) -> str:
    """``sql`` behind the definitions of the views it names; ``extra`` adds named queries."""
    named = {v: VIEWS[v] for v in needed_views(" ".join([sql, *extra.values()]))}
    named.update(extra)
    if not named:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({query})" for name, query in named.items()) + "\n" + sql
