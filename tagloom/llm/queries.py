"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm import (
    clusters,
    html,
    licenses,
    minhash,
    mixing,
    multi_index,
    packing,
    phrases,
    pii,
    quality,
    secrets,
    substrings,
    topk,
)
from tagloom.llm.tables import written
from tagloom.session import small_side

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and offsets of personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    proposed = written(pii.propose(docs).drop("text"), "proposed")
    found = pii.select(proposed, pii.fit(proposed))
    n = lambda kind: F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("personal"), pii.KINDS[:4]), 256).alias("base_sha256"),
        pii.listed(F.col("personal")).alias("spans"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("measures")
    return quality.judge(docs).select(
        "doc_id",
        *[m[x].alias(x) for x in QUALITY_COUNTS],
        (~quality.passes(quality.BASE_RULES, m)).alias("base_failed"),
        (F.size("measures_failed") == 0).alias("kept"),
    )


def tokenizer_path() -> str:
    """The tokenizer file that packing uses here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, its source's size and target, and the words taken of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mix = mixing.Mix(docs)
    of = mix.sources.select(
        F.col("source").alias("of"), F.col("words").alias("source_size"), "target"
    )
    rows = mix.rows.select("doc_id", "mix__source", "mix__size", "mix__shards")
    return rows.join(small_side(of), F.col("mix__source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        F.col("mix__size").alias("size"),
        "source_size",
        "target",
        (F.size("mix__shards") * F.col("mix__size")).cast("long").alias("taken"),
        F.array_join("mix__shards", ",").alias("shards"),
    )


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every fiftieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds, and how tight the clusters are."""
    found = clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUALITY_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

QUALITY_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), split AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), words AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM split
), windows AS (
  SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), repeated AS (
  SELECT r, i FROM (
    SELECT r, i, c, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows)
  WHERE c IS NOT NULL AND n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), counts AS (
  SELECT d.r, d.doc_id,
    CAST(len(s.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(s.w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(l.n_lines, 0) AS n_lines,
    len(list_filter(s.w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM docs d JOIN split s USING (r) LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000
    AND word_chars / n_words BETWEEN 2.0 AND 12.0
    AND n_symbols / word_chars <= 0.1
    AND n_stop / n_words >= 0.02
    AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM judged
"""


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that an earlier document or line has as well, with its original offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.repeated_passages(docs).select(
        F.col("id").alias("doc_id"), "start", "end", "units", "words"
    )


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links and component of every vector at cosine 0.9."""
    found = multi_index.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


NEAR_VECTORS_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
  least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id <= coalesce(m, vec_id) AS kept
FROM vectors LEFT JOIN counts c ON c.x = vec_id LEFT JOIN least l ON l.x = vec_id
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and offsets of the secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).select("doc_id", "secrets")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(F.col("secrets"), secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document; 3-word shingles, similarity 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, words=3, percent=85)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM split
        WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), least AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.x = d.doc_id
"""

def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.find_licenses(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _license_sql() -> str:
    sentence = "s"
    names = " ".join(
        f"WHEN regexp_matches({sentence}, '{pattern}') THEN '{name}'" for name, pattern in licenses.SENTENCES
    )
    steps, last = [], "chains"
    for k, (name, pattern) in enumerate(licenses.RULES):
        hit = f"regexp_matches(rest, '{pattern}')"
        versions = licenses.GENERAL.get(name)
        new = "" if versions is None else f" AND len(list_filter(found, lambda x: starts_with(x, '{versions}'))) = 0"
        steps.append(
            f"step{k} AS (SELECT r, CASE WHEN {hit} "
            f"THEN regexp_replace(rest, '{pattern}', '', 'g') ELSE rest END AS rest, "
            f"CASE WHEN {hit}{new} "
            f"THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"step{k}"
    plain = "chr(10) || text"
    for pattern, new in licenses.STEPS:
        new = new.replace("{1}", "\\1").replace("\n", "' || chr(10) || '")
        plain = f"regexp_replace({plain}, '{pattern}', '{new}', 'g')"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, generate_subscripts(p, 1) AS i, unnest(p) AS s
  FROM (SELECT r, regexp_split_to_array({plain}, '{licenses.SENTENCE_END}') AS p FROM docs)
), parts AS (
  SELECT r, i, CASE WHEN regexp_matches(s, '{licenses.SPDX}') THEN list_transform(
    regexp_split_to_array(regexp_replace(s, '{licenses.SPDX}', ''), '{licenses.SPDX_PARTS}'),
    lambda x: 'SPDX-License-Identifier ' || x) ELSE [s] END AS p
  FROM cut WHERE regexp_matches(lower(s), '{licenses.KEY_WORDS}')
), keyed AS (
  SELECT r, i * 100000 + j AS i, ' ' || trim(regexp_replace(
    regexp_replace(lower(s), '{licenses.IN_NUMBER}', '\1_\2', 'g'),
    '{licenses.NOT_WORD}', ' ', 'g')) || ' ' AS s
  FROM (SELECT r, i, generate_subscripts(p, 1) AS j, unnest(p) AS s FROM parts)
), named AS (
  SELECT r, i, CASE {names} END AS name FROM keyed
), chains AS (
  SELECT r, string_agg(';' || name || ';', '' ORDER BY i) AS rest, CAST([] AS VARCHAR[]) AS found
  FROM named WHERE name IS NOT NULL GROUP BY r
), {", ".join(steps)}, sequences AS (
  SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids
  FROM named WHERE name IS NOT NULL GROUP BY r
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
  coalesce(array_to_string(found, ','), '') AS licenses
FROM docs LEFT JOIN sequences USING (r) LEFT JOIN {last} USING (r)
"""


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""


def _clusters_sql(rounds: int = 10) -> str:
    """The rounds written out: an assignment and new centroids each."""

    def assign(r: int) -> str:
        return f"""assigned{r} AS MATERIALIZED (
  SELECT r, vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT v.r, v.vec_id, c.cluster, list_sum(list_transform(range(1, 65),
      lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS d
    FROM v CROSS JOIN centroids{r} AS c)
  GROUP BY r, vec_id)"""

    steps = [assign(0)]
    for r in range(rounds):
        steps.append(f"""centroids{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM centroids{r} AS c LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS e FROM (
      SELECT cluster, i, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS x FROM (
        SELECT a.cluster, generate_subscripts(v.e, 1) AS i, unnest(v.e) AS x
        FROM assigned{r} AS a JOIN v USING (r))
      GROUP BY cluster, i)
    GROUP BY cluster) AS m USING (cluster))""")
        steps.append(assign(r + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), centroids0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS INTEGER) AS cluster, e
  FROM v ORDER BY sha256('3:' || vec_id), e LIMIT 8
), {", ".join(steps)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM assigned{rounds} JOIN centroids{rounds} AS c USING (cluster)
"""


COLLOCATIONS_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)
), lists AS (
  SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT p, lang, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM lists
), windows AS (
  SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d
  FROM words WINDOW o AS (PARTITION BY p ORDER BY i)
), counts AS MATERIALIZED (
  SELECT lang, w, count(*) AS f FROM (
    SELECT lang, [a] AS w FROM windows
    UNION ALL SELECT lang, [a, b] FROM windows WHERE b IS NOT NULL
    UNION ALL SELECT lang, [a, b, c] FROM windows WHERE c IS NOT NULL
    UNION ALL SELECT lang, [a, b, c, d] FROM windows WHERE d IS NOT NULL)
  GROUP BY lang, w HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), cuts AS (
  SELECT x.lang, x.w, x.f AS a, k, l.f AS l, r.f AS r,
    (CAST(2000000 AS HUGEINT) * x.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM counts) AS x
  JOIN counts AS l ON l.lang = x.lang AND l.w = x.w[1:k]
  JOIN counts AS r ON r.lang = x.lang AND r.w = x.w[k + 1:]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1
), held AS (
  SELECT lang, s AS w, max(f) AS f FROM (
    SELECT lang, f, w[i:i + m - 1] AS s FROM (
      SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (
        SELECT *, unnest(range(2, len(w))) AS m FROM counts)))
  GROUP BY lang, s
), kept AS (
  SELECT c.lang, array_to_string(c.w, ' ') AS phrase, a, l, r, score
  FROM lowest AS c LEFT JOIN held AS h ON h.lang = c.lang AND h.w = c.w
  WHERE h.f IS NULL OR CAST(100 AS HUGEINT) * h.f < CAST(80 AS HUGEINT) * a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_vectors": op3_near_vectors,
    "op4_secret_scan": op4_secret_scan,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_personal_data": op6_personal_data,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op3_near_vectors": NEAR_VECTORS_SQL,
    "op5_near_duplicates": NEAR_DUPLICATES_SQL,
    "op7_quality_rules": QUALITY_SQL,
    "op10_license_scan": _license_sql(),
    "op11_exact_top_k": TOP_K_SQL,
    "op12_centroid_clusters": _clusters_sql(),
    "op13_collocations": COLLOCATIONS_SQL,
}
