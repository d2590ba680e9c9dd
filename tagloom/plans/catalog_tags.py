"""Registered queries: answer parsing and tag normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import prompts as P
from tagloom.functions import responses as J
from tagloom.functions import routes
from tagloom.functions.lexical import STOP_WORDS
from tagloom.operators import association as A
from tagloom.operators import evaluation as V
from tagloom.operators import normalize as N
from tagloom.operators import similarity as M
from tagloom.operators.components import connected_components, extend_components
from tagloom.operators.rules import mined_rules
from tagloom.plans.catalog_records import docs, quote, ws
from tagloom.plans.fixtures import tagged_occurrences, view, with_views
from tagloom.plans.normalization import lexical_mapping, normalize_tags
from tagloom.session import cut_lineage
from tagloom.sources import sinks as K

STRICT_SIMILARITY = 0.6
PAIR_SIMILARITY = 0.3


def _pairs_text(tags: Column) -> Column:
    """Tag structs as one text, for comparison."""
    shown = F.transform(tags, lambda t: F.concat_ws("~", t["tag"], t["explanation"]))
    return F.array_join(shown, "|")


def _parsed(spark, sf, tags: Column) -> DataFrame:
    return view(spark, sf, "fx_responses").select("sample_id", tags.alias("tags"))


def parse_tags_basic(spark, sf):
    return _parsed(spark, sf, F.array_join(J.tags_basic(F.col("raw_response")), "|"))


def parse_tags_strict(spark, sf):
    return _parsed(spark, sf, F.array_join(J.tags_strict(F.col("raw_response")), "|"))


def parse_tags_explained(spark, sf):
    return _parsed(spark, sf, _pairs_text(J.tags_explained(F.col("raw_response"))))


def parse_tags_objects(spark, sf):
    return _parsed(spark, sf, _pairs_text(J.tags_objects(F.col("raw_response"))))


def parse_tags_objects_all(spark, sf):
    return _parsed(spark, sf, _pairs_text(J.tags_objects(F.col("raw_response"), cap=None)))


def parse_tags_longest(spark, sf):
    rows = _parsed(spark, sf, J.tags_longest(F.col("raw_response")))
    return rows.select("sample_id", _pairs_text(F.col("tags.tags")).alias("tags"), "tags.success")


def parse_tags_lines(spark, sf):
    return _parsed(spark, sf, _pairs_text(J.tags_from_lines(F.col("raw_response"))))


def parse_tags_comma(spark, sf):
    return _parsed(spark, sf, F.array_join(J.tags_comma(F.col("raw_response")), "|"))


def parse_tags_string(spark, sf):
    rows = view(spark, sf, "fx_tag_text")
    return rows.select("sample_id", F.array_join(J.tags_string(F.col("tags")), "|").alias("tags"))


def parse_tags_eval(spark, sf):
    return _parsed(spark, sf, _pairs_text(J.tags_evaluated(F.col("raw_response"))))


def _routed(spark, sf, route: Column) -> DataFrame:
    return view(spark, sf, "fx_predictions").select("sample_id", route.alias("prediction"))


def parse_route_single(spark, sf):
    return _routed(spark, sf, routes.route_single(F.col("raw_generated_text")))


def parse_route_lenient(spark, sf):
    return _routed(spark, sf, routes.route_lenient(F.col("raw_generated_text")))


def parse_route_multi(spark, sf):
    return _routed(spark, sf, F.array_join(routes.route_multi(F.col("raw_generated_text")), "|"))


def strip_echo(spark, sf):
    prompt = P.tagging_prompt(F.col("text"), "query_plain")
    raw = F.when(F.col("lang") == "en", F.concat(prompt, F.lit(" "), "source")).otherwise(F.col("source"))
    return docs(spark, sf).select("sample_id", J.without_echo(raw, prompt).alias("answer"))


def invalid_sidecar(spark, sf):
    """Tagged and untagged results, labelled; one pass writes both."""
    rows = view(spark, sf, "fx_responses").select(
        "sample_id", "raw_response", J.tags_strict(F.col("raw_response")).alias("tags")
    )
    return K.label_valid(rows).select(
        "kind",
        "sample_id",
        F.array_join("tags", "|").alias("tags"),
        F.when(F.col("kind") == K.INVALID, F.col("raw_response")).alias("output"),
    )


def inference_summary(spark, sf):
    parsed = _parsed(spark, sf, J.tags_longest(F.col("raw_response")))
    return V.inference_summary(parsed, J.tagging_succeeded(F.col("tags.tags")))


def tagged_ratio(spark, sf):
    return V.tagged_ratio(_parsed(spark, sf, J.tags_strict(F.col("raw_response"))))


# --- normalization ---------------------------------------------------------------------------


_occurrences = tagged_occurrences


def tag_frequency(spark, sf):
    return N.tag_frequency(_occurrences(spark, sf))


def tag_frequency_filter(spark, sf):
    return N.frequent_tags(N.tag_frequency(_occurrences(spark, sf)))


def tag_lexical_key(spark, sf):
    return N.lexical_keys(N.tag_frequency(_occurrences(spark, sf)))


def tag_rule_groups(spark, sf):
    return lexical_mapping(_occurrences(spark, sf))


def _canonical(spark, sf) -> DataFrame:
    return cut_lineage(N.canonical_tags(lexical_mapping(_occurrences(spark, sf))))


def tag_tfidf(spark, sf):
    weights = M.tag_tfidf(M.tag_vectors(_canonical(spark, sf)))
    return weights.select("tag", "term", "df", F.round("weight", 6).alias("weight"))


def tag_similarity_pairs(spark, sf):
    pairs = M.similar_pairs(cut_lineage(M.tag_vectors(_canonical(spark, sf))), PAIR_SIMILARITY)
    return pairs.select("src", "dst", F.round("cosine", 6).alias("cosine"))


def tag_semantic_groups(spark, sf):
    return M.semantic_groups(_canonical(spark, sf))


def tag_semantic_groups_strict(spark, sf):
    return M.semantic_groups(_canonical(spark, sf), STRICT_SIMILARITY)


def tag_groups_grown(spark, sf):
    """Similarity groups of half of the links, into which the other half comes in two more runs."""
    tags = cut_lineage(_canonical(spark, sf))
    links = cut_lineage(M.similarity_links(cut_lineage(M.tag_vectors(tags)), M.MIN_SIMILARITY))
    part = F.pmod(F.xxhash64("src", "dst"), F.lit(4))
    labels = cut_lineage(connected_components(links.filter(part < 2)))
    for arriving in (2, 3):
        labels = cut_lineage(extend_components(labels, links.filter(part == arriving)))
    canonical = labels.select(F.col("node").alias("tag"), F.col("component").alias("canonical"))
    return tags.join(canonical, "tag", "left").select("tag", F.coalesce("canonical", "tag").alias("canonical"))


def mapped_sessions(spark, sf):
    occurrences = _occurrences(spark, sf)
    rows = A.mapped_sessions(occurrences, lexical_mapping(occurrences))
    return rows.select("sample_id", F.array_join("tags", "|").alias("tags"))


def _itemsets(spark, sf) -> DataFrame:
    occurrences = _occurrences(spark, sf)
    return A.frequent_itemsets(A.canonical_baskets(occurrences, lexical_mapping(occurrences)))


def frequent_itemsets(spark, sf):
    return _itemsets(spark, sf).select(F.array_join("items", "|").alias("items"), "n")


def _small_itemsets(spark, sf):
    occurrences = _occurrences(spark, sf)
    return A.small_itemsets(A.canonical_baskets(occurrences, lexical_mapping(occurrences)))


def frequent_pairs(spark, sf):
    return A.frequent_pairs(_small_itemsets(spark, sf))


def _rules(spark, sf, **kind) -> DataFrame:
    occurrences = _occurrences(spark, sf)
    baskets = A.canonical_baskets(occurrences, lexical_mapping(occurrences))
    return mined_rules(baskets, A.MIN_SUPPORT, A.MIN_CONFIDENCE, **kind)


def association_rules(spark, sf):
    return _rules(spark, sf).select(
        F.array_join("antecedent", "|").alias("antecedent"),
        F.col("consequent")[0].alias("consequent"),
        F.round("confidence", 6).alias("confidence"),
    )


def association_rules_full(spark, sf):
    """Every split of every frequent set that holds, several tags on the right side included."""
    return _rules(spark, sf, full=True).select(
        F.array_join("antecedent", "|").alias("antecedent"),
        F.array_join("consequent", "|").alias("consequent"),
        "n",
        F.round("confidence", 6).alias("confidence"),
    )


def association_pairs(spark, sf):
    rules = A.association_pairs(_small_itemsets(spark, sf))
    return rules.withColumn("confidence", F.round("confidence", 6))


def tag_assoc_groups(spark, sf):
    occurrences = _occurrences(spark, sf)
    return A.association_groups(occurrences, lexical_mapping(occurrences))


def apply_tag_mapping(spark, sf):
    occurrences = _occurrences(spark, sf)
    return N.apply_mapping(occurrences, lexical_mapping(occurrences))


def clean_tag_records(spark, sf):
    """Records that hold their tags as a list, in several spellings."""
    spelled = F.array(
        "lang",
        F.when(F.col("sample_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")),
        F.concat(F.col("lang"), F.lit("!")),
        F.concat(F.lit("rare "), F.col("sample_id").cast("string")),
        "source",
    )
    records = docs(spark, sf).select("sample_id", spelled.alias("tags"))
    mapping = lexical_mapping(N.tag_occurrences(records))
    return N.clean_records(records, mapping)


def tag_top20(spark, sf):
    occurrences = _occurrences(spark, sf)
    return N.top_tags(occurrences, lexical_mapping(occurrences))


def tag_mapping_final(spark, sf):
    return normalize_tags(_occurrences(spark, sf)).final


def tag_reduction(spark, sf):
    occurrences = _occurrences(spark, sf)
    return N.reduction_steps(occurrences, normalize_tags(occurrences).steps())


def tag_stats(spark, sf):
    occurrences = _occurrences(spark, sf)
    return N.normalization_stats(occurrences, normalize_tags(occurrences).final)


QUERIES = {
    f.__name__: f
    for f in (
        parse_tags_basic, parse_tags_strict, parse_tags_explained, parse_tags_objects,
        parse_tags_objects_all, parse_tags_longest, parse_tags_lines, parse_tags_comma,
        parse_tags_string, parse_tags_eval, parse_route_single, parse_route_lenient,
        parse_route_multi, strip_echo, invalid_sidecar, inference_summary, tagged_ratio,
        tag_frequency, tag_frequency_filter, tag_lexical_key, tag_rule_groups, tag_tfidf,
        tag_similarity_pairs, tag_semantic_groups, tag_semantic_groups_strict, tag_groups_grown, mapped_sessions,
        frequent_itemsets, frequent_pairs, association_rules, association_rules_full, association_pairs, tag_assoc_groups,
        apply_tag_mapping, clean_tag_records, tag_top20, tag_mapping_final, tag_reduction, tag_stats,
    )
}


# --- the same results in SQL -----------------------------------------------------------------

_TAG_VALUES = "regexp_extract_all({r}, '\"tag\"\\s*:\\s*\"([^\"]+)\"', 1)"
_PAIR = """list_transform(list_filter(json_extract({j}, '$[*]'), lambda x:
  json_extract_string(x, '$.tag') IS NOT NULL AND json_extract_string(x, '$.explanation') IS NOT NULL),
  lambda x: trim(json_extract_string(x, '$.tag')) || '~' || trim(json_extract_string(x, '$.explanation')))"""
_STRIP_QUOTES = "replace(replace({x}, '\"', ''), '''', '')"

BASIC = f"""CASE WHEN starts_with({ws('raw_response')}, '[') AND json_valid(raw_response)
   THEN list_filter(json_extract_string(raw_response, '$[*].tag'), lambda x: x IS NOT NULL)
   ELSE {_TAG_VALUES.format(r='raw_response')} END"""
STRICT = f"""list_filter(list_transform(CASE WHEN json_valid(trim(raw_response)) AND trim(raw_response) LIKE '[%'
     THEN json_extract_string(trim(raw_response), '$[*].tag')
   WHEN json_valid(trim(raw_response)) AND json_extract_string(trim(raw_response), '$.tag') IS NOT NULL
     THEN [json_extract_string(trim(raw_response), '$.tag')]
   ELSE {_TAG_VALUES.format(r='raw_response')} END, lambda x: {ws('x')}), lambda x: x <> '')"""

# Line reading as sets: a run of lines starts at each opening line; its explanation is the last
# labelled one, or the first free line behind that while it is empty.
_LINE_VIEWS = {
    "raw_lines": f"""SELECT sample_id, row_number() OVER () AS ord, unnest(list_transform(string_split(raw_response, chr(10)),
        lambda l, i: {{'line': {ws('l')}, 'i': i}}), recursive := true) FROM fx_responses""",
    "kinds": f"""SELECT sample_id, i, CASE WHEN contains(line, ':') AND contains(lower(line), 'tag') THEN 't'
          WHEN contains(line, ':') AND contains(lower(line), 'explanation') THEN 'e' ELSE 'o' END AS kind,
        CASE WHEN contains(line, ':') AND (contains(lower(line), 'tag') OR contains(lower(line), 'explanation'))
          THEN {_STRIP_QUOTES.format(x=ws("substr(line, instr(line, ':') + 1)"))}
          ELSE {_STRIP_QUOTES.format(x='line')} END AS val
      FROM raw_lines WHERE line <> ''""",
    "runs": """SELECT *, count(*) FILTER (kind = 't') OVER (PARTITION BY sample_id ORDER BY i) AS run FROM kinds""",
    "labelled": """SELECT sample_id, run, max(i) FILTER (kind = 'e') AS ei, arg_max(val, i) FILTER (kind = 'e') AS ev,
        min(i) AS ti, arg_min(val, i) FILTER (kind = 't') AS tag FROM runs WHERE run > 0 GROUP BY ALL""",
    "line_pairs": """SELECT l.sample_id, l.ti, l.tag, CASE WHEN l.ev <> '' THEN l.ev ELSE
        (SELECT arg_min(r.val, r.i) FROM runs r WHERE r.sample_id = l.sample_id AND r.run = l.run AND r.kind = 'o'
           AND r.val <> '' AND r.i > coalesce(l.ei, 0)) END AS expl FROM labelled l""",
    "line_tags": """SELECT r.sample_id, coalesce(t.tags, ['General~Unable to parse specific tags']) AS tags
      FROM fx_responses r LEFT JOIN (SELECT sample_id, list(tag || '~' || expl ORDER BY ti)[1:5] AS tags
        FROM line_pairs WHERE tag <> '' AND expl <> '' GROUP BY sample_id) t USING (sample_id)""",
}
_LAST = r"list_extract(regexp_extract_all(raw_response, '\[[^\]]*\]'), -1)"
_OBJECTS = """regexp_extract_all(raw_response, '\\{[^{}]*"tag"[^{}]*"explanation"[^{}]*\\}')"""
_LOOSE_T = """regexp_extract_all(raw_response, '"tag":\\s*"([^"]*)"', 1)"""
_LOOSE_E = """regexp_extract_all(raw_response, '"explanation":\\s*"([^"]*(?:[^"\\\\]|\\\\.)*)"\\s*[,}]', 1)"""
_EXACT_TAGS, _EXACT_TEXTS = (
    f"regexp_extract_all(raw_response, {quote(J.EXACT_TAG_OBJECT)}, {group})" for group in (1, 2)
)


def _answers(expression: str, *, lines: bool = False) -> str:
    if lines:
        sql = f"""SELECT sample_id, array_to_string({expression}, '|') AS tags FROM
          (SELECT *, {_LAST} AS last_list, {_OBJECTS} AS objects FROM fx_responses) r
          JOIN (SELECT sample_id, tags AS from_lines FROM line_tags) l USING (sample_id)"""
        return with_views(sql, **_LINE_VIEWS)
    return with_views(f"SELECT sample_id, array_to_string({expression}, '|') AS tags FROM fx_responses")


_LIST_PAIRS = f"CASE WHEN last_list IS NOT NULL AND json_valid(last_list) THEN {_PAIR.format(j='last_list')} END"
_OBJECT_PAIRS = f"""list_transform(list_filter(objects, lambda o: json_valid(o)), lambda o:
  trim(json_extract_string(o, '$.tag')) || '~' || trim(json_extract_string(o, '$.explanation')))"""


def _objects(cap: str) -> str:
    return _answers(
        f"""CASE WHEN last_list IS NOT NULL AND json_valid(last_list) THEN ({_LIST_PAIRS}){cap}
            WHEN len(objects) > 0 THEN ({_OBJECT_PAIRS}){cap} ELSE from_lines END""",
        lines=True,
    )


_LONGEST = f"""
SELECT sample_id, CASE WHEN doc IS NULL THEN 'Error~Failed to parse JSON' ELSE array_to_string(list_transform(
    CASE WHEN json_type(doc) = 'ARRAY' THEN json_extract(doc, '$[*]') ELSE [doc] END,
    lambda x: concat_ws('~', json_extract_string(x, '$.tag'), json_extract_string(x, '$.explanation'))), '|') END AS tags,
  doc IS NOT NULL AS success
FROM (SELECT sample_id, CASE WHEN json_valid(longest) THEN CAST(longest AS JSON)
        WHEN len(ts) > 0 AND len(ts) = len(es) THEN CASE WHEN json_valid(rebuilt) THEN CAST(rebuilt AS JSON) END
        WHEN json_valid(raw_response) THEN CAST(raw_response AS JSON) END AS doc
  FROM (SELECT *, list_extract(list_filter(spans, lambda s: length(s) = list_max(list_transform(spans, lambda z: length(z)))), 1) AS longest,
          '[' || array_to_string(list_transform(list_zip(ts, es), lambda p: '{{"tag": "' || p[1] || '", "explanation": "' || p[2] || '"}}'), ', ') || ']' AS rebuilt
    FROM (SELECT *, regexp_extract_all(raw_response, '\\[[^\\]]*\\]|\\{{[^}}]*\\}}') AS spans, {_LOOSE_T} AS ts, {_LOOSE_E} AS es
          FROM fx_responses) a) b) c"""

_EVALUATED = f"""CASE WHEN json_valid(raw_response) AND raw_response LIKE '[%' THEN
    list_transform(json_extract(raw_response, '$[*]'), lambda x: json_extract_string(x, '$.tag') || '~' || json_extract_string(x, '$.explanation'))
  ELSE list_transform(list_zip({_EXACT_TAGS}, {_EXACT_TEXTS}), lambda p: p[1] || '~' || p[2]) END"""

# Router answers; the braced part is read as JSON only when it is valid.
CLEAN_ANSWER = ws(r"regexp_replace(regexp_replace(raw_generated_text, '(?i)```json\s*', '', 'g'), '```\s*', '', 'g')")
_SPAN = "CASE WHEN instr({a}, '{{') > 0 AND contains({a}, '}}') THEN substr({a}, instr({a}, '{{'), length({a}) - instr(reverse({a}), '}}') + 2 - instr({a}, '{{')) END"


def _first_group(a: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({a}, {quote(pattern)}) THEN regexp_extract({a}, {quote(pattern)}, 1) END"


def _json_route(a: str) -> str:
    span = _SPAN.format(a=a)
    return f"CASE WHEN json_valid({span}) THEN {ws(f'json_extract_string({span}, $p$$.best_model$p$)')} END"


def _bare(value: str) -> str:
    return f"trim({ws(value)}, {quote(chr(34) + chr(39))})"


def _route_oracle(expression: str, source: str) -> str:
    return with_views(
        f"SELECT sample_id, {expression} AS prediction FROM (SELECT sample_id, {source} AS a FROM fx_predictions) t"
    )


ROUTE_SINGLE = "coalesce({}, {}, {}, '{}')".format(
    ws(_first_group("a", routes.CLOSED_OBJECT)),
    _json_route("a"),
    ", ".join(
        f"nullif({_bare(_first_group('a', p))}, '')"
        for p in (routes.DOUBLE_QUOTED, routes.SINGLE_QUOTED, routes.BARE_VALUE)
    ),
    routes.GENERATION_ERROR,
)


def _without_lead_ins(line: str) -> str:
    for phrase in routes.LEAD_INS:
        line = f"(CASE WHEN starts_with({line}, {quote(phrase)}) THEN {ws(f'substr({line}, {len(phrase) + 1})')} ELSE {line} END)"
    return line


_USEFUL = f"""list_extract(list_filter(list_transform(list_filter(list_transform(string_split(a, chr(10)), lambda l: {ws('l')}),
   lambda l: l <> '' AND NOT starts_with(l, '{{') AND NOT starts_with(l, '}}') AND NOT starts_with(l, '"best_model"')),
   lambda l: trim({_without_lead_ins('l')}, {quote(chr(34) + chr(39) + '.,')})), lambda l: l <> ''), 1)"""
ROUTE_LENIENT = "coalesce({}, {}, {}, {}, '')".format(
    ws(_first_group("a", routes.ANY_OBJECT)),
    _json_route("a"),
    ", ".join(
        _bare(_first_group("a", p))
        for p in (routes.DOUBLE_QUOTED, routes.SINGLE_QUOTED, routes.BARE_VALUE_LENIENT)
    ),
    _USEFUL,
)
ROUTE_MULTI = f"""list_filter(list_transform(regexp_extract_all(raw_generated_text, {quote(routes.OPEN_VALUE)}, 1),
  lambda x: {ws('x')}), lambda x: x <> '')"""

_WORDS = "list_filter(string_split(regexp_replace(lower(tag), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_STEM = """CASE WHEN ends_with(w, 'ing') THEN left(w, length(w) - 3) WHEN ends_with(w, 'ed') THEN left(w, length(w) - 2)
  WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"""
LEXICAL_KEY = f"array_to_string(list_filter(list_transform({_WORDS}, lambda w: {_STEM}), lambda w: w <> ''), ' ')"

RULE_VIEWS = {
    "frequency": "SELECT tag, count(*) AS n FROM fx_tagged GROUP BY tag",
    "frequent": "SELECT tag, n FROM frequency WHERE n >= 20",
    "keyed": f"SELECT tag, {LEXICAL_KEY} AS lexical_key FROM frequent",
    "rule_map": "SELECT tag, min(tag) OVER (PARTITION BY lexical_key) AS canonical FROM keyed",
}
_STOPS = "[" + ", ".join(quote(w) for w in STOP_WORDS) + "]"
TFIDF_VIEWS = {
    **RULE_VIEWS,
    "canon": "SELECT DISTINCT canonical AS tag FROM rule_map",
    "toks": f"""SELECT tag, list_filter(regexp_extract_all(lower(tag), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda w: NOT list_contains({_STOPS}, w)) AS w FROM canon""",
    "terms": """SELECT tag, term, count(*) AS tf FROM (SELECT tag, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM toks) t GROUP BY tag, term""",
    "vocab": """SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM canon)) / (1.0 + count(*))) + 1 AS idf
        FROM terms GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000""",
    "tfidf": """SELECT tag, term, df, tf*idf / sqrt(sum(tf*idf*tf*idf) OVER (PARTITION BY tag)) AS weight
        FROM terms JOIN vocab USING (term)""",
}
PAIR_VIEWS = {
    **TFIDF_VIEWS,
    "shapes": """SELECT tag, string_agg(term || '=' || CAST(round(weight, 9) AS VARCHAR), ';' ORDER BY term) AS shape
        FROM tfidf GROUP BY tag""",
    "reps": "SELECT tag, min(tag) OVER (PARTITION BY shape) AS rep FROM shapes",
    "all_pairs": """SELECT a.tag AS src, b.tag AS dst, round(sum(a.weight * b.weight), 12) AS cosine
        FROM tfidf a JOIN tfidf b USING (term) JOIN reps ra ON ra.tag = a.tag AND ra.rep = a.tag
        JOIN reps rb ON rb.tag = b.tag AND rb.rep = b.tag WHERE a.tag < b.tag GROUP BY a.tag, b.tag
        UNION ALL SELECT rep, tag, 1.0 FROM reps WHERE rep <> tag""",
}


def group_views(similarity: float) -> dict[str, str]:
    """Similarity groups of the canonical tags as the closure of their links."""
    return {
        **PAIR_VIEWS,
        "links": f"""SELECT src, dst FROM all_pairs WHERE cosine >= {similarity}
          UNION ALL SELECT dst, src FROM all_pairs WHERE cosine >= {similarity}""",
        "reach": """SELECT tag, tag AS other FROM canon UNION
          SELECT r.tag, l.dst FROM reach r JOIN links l ON l.src = r.other""",
        "semantic": "SELECT tag, min(other) AS canonical FROM reach GROUP BY tag",
    }


def _groups(similarity: float) -> str:
    return with_views(
        "SELECT tag, canonical FROM semantic", recursive=True, **group_views(similarity)
    )


def basket_views(mapping: str) -> dict[str, str]:
    """Frequent item sets by extending each set with a later item of the same basket, their
    rules, and the groups the rules form."""
    return {
        "basket": f"SELECT DISTINCT sample_id, canonical AS item FROM fx_tagged JOIN {mapping} USING (tag)",
        "singles": "SELECT item, count(*) AS n FROM basket GROUP BY item",
        "often": "SELECT sample_id, item FROM basket WHERE item IN (SELECT item FROM singles WHERE n >= 40)",
        "grow": """SELECT sample_id, item AS items, item AS last FROM often
          UNION ALL SELECT sample_id, items, last FROM (
            SELECT g.sample_id, g.items || '|' || o.item AS items, o.item AS last
            FROM grow g JOIN often o ON o.sample_id = g.sample_id AND o.item > g.last) s
          QUALIFY count(*) OVER (PARTITION BY items) >= 40""",
        "itemsets": "SELECT items, count(*) AS n FROM grow GROUP BY items",
        "splits": """SELECT n, c AS consequent, array_to_string(list_filter(l, lambda x: x <> c), '|') AS antecedent
          FROM (SELECT n, l, unnest(l) AS c FROM (SELECT n, string_split(items, '|') AS l FROM itemsets) i) u
          WHERE len(l) > 1""",
        "rules": """SELECT antecedent, consequent, s.n * 1.0 / i.n AS confidence FROM splits s
          JOIN itemsets i ON i.items = s.antecedent WHERE s.n * 1.0 / i.n >= 0.99""",
        "ties": """SELECT DISTINCT consequent AS a, unnest(string_split(antecedent, '|')) AS b FROM rules""",
        "closure": f"""SELECT DISTINCT canonical AS tag, canonical AS other FROM {mapping} UNION
          SELECT c.tag, t.b FROM closure c JOIN (SELECT a, b FROM ties UNION SELECT b, a FROM ties) t ON t.a = c.other""",
        "assoc": "SELECT tag, min(other) AS canonical FROM closure GROUP BY tag",
    }


BASKETS = {**RULE_VIEWS, **basket_views("rule_map")}
PIPELINE = {
    **group_views(M.MIN_SIMILARITY),
    "semantic_map": "SELECT r.tag, s.canonical FROM rule_map r JOIN semantic s ON s.tag = r.canonical",
    **basket_views("semantic_map"),
    "final_map": "SELECT m.tag, a.canonical FROM semantic_map m JOIN assoc a ON a.tag = m.canonical",
}
_CLEANED = {
    **RULE_VIEWS,
    "cleaned": """SELECT sample_id, canonical, min(pos) AS pos FROM fx_tagged JOIN rule_map USING (tag)
        GROUP BY sample_id, canonical""",
}

ORACLES = {
    "parse_tags_basic": _answers(f"({BASIC})[1:5]"),
    "parse_tags_strict": _answers(f"({STRICT})[1:5]"),
    "parse_tags_explained": _answers(
        f"CASE WHEN len({_LIST_PAIRS}) > 0 THEN ({_LIST_PAIRS})[1:5] ELSE from_lines END", lines=True
    ),
    "parse_tags_objects": _objects("[1:5]"),
    "parse_tags_objects_all": _objects(""),
    "parse_tags_longest": with_views(_LONGEST),
    "parse_tags_lines": _answers("from_lines", lines=True),
    "parse_tags_comma": _answers(
        f"list_filter(list_transform(string_split(raw_response, ','), lambda x: {ws('x')}), lambda x: x <> '')[1:5]"
    ),
    "parse_tags_string": with_views(
        f"""SELECT sample_id, array_to_string(list_filter(list_transform(string_split(
          trim({ws("coalesce(tags, '')")}, {quote(chr(34) + chr(39))}), ','), lambda x: {ws('x')}), lambda x: x <> ''), '|') AS tags
        FROM fx_tag_text"""
    ),
    "parse_tags_eval": _answers(_EVALUATED),
    "parse_route_single": _route_oracle(ROUTE_SINGLE, CLEAN_ANSWER),
    "parse_route_lenient": _route_oracle(ROUTE_LENIENT, "raw_generated_text"),
    "parse_route_multi": with_views(
        f"SELECT sample_id, array_to_string({ROUTE_MULTI}, '|') AS prediction FROM fx_predictions"
    ),
    "strip_echo": "SELECT doc_id AS sample_id, source AS answer FROM documents",
    "invalid_sidecar": with_views(
        f"""SELECT CASE WHEN len(t) > 0 THEN 'valid' ELSE 'invalid' END AS kind, sample_id, array_to_string(t, '|') AS tags,
          CASE WHEN len(t) = 0 THEN raw_response END AS output
        FROM (SELECT *, ({STRICT})[1:5] AS t FROM fx_responses) r"""
    ),
    "inference_summary": f"""SELECT count(*) AS total_samples, count(*) FILTER (success) AS successful_samples,
        round(count(*) FILTER (success) * 100.0 / count(*), 2) AS success_rate FROM ({with_views(_LONGEST)}) t""",
    "tagged_ratio": with_views(
        f"""SELECT count(*) AS total, count(*) FILTER (len(t) > 0) AS tagged,
          round(count(*) FILTER (len(t) > 0) * 100.0 / count(*), 1) AS pct
        FROM (SELECT ({STRICT})[1:5] AS t FROM fx_responses) r"""
    ),
    "tag_frequency": with_views("SELECT tag, n FROM frequency", frequency=RULE_VIEWS["frequency"]),
    "tag_frequency_filter": with_views("SELECT tag, n FROM frequent", **RULE_VIEWS),
    "tag_lexical_key": with_views(
        f"SELECT tag, {LEXICAL_KEY} AS lexical_key FROM frequency", frequency=RULE_VIEWS["frequency"]
    ),
    "tag_rule_groups": with_views("SELECT tag, canonical FROM rule_map", **RULE_VIEWS),
    "tag_tfidf": with_views("SELECT tag, term, df, round(weight, 6) AS weight FROM tfidf", **TFIDF_VIEWS),
    "tag_similarity_pairs": with_views(
        f"SELECT src, dst, round(cosine, 6) AS cosine FROM all_pairs WHERE cosine >= {PAIR_SIMILARITY}",
        **PAIR_VIEWS,
    ),
    "tag_semantic_groups": _groups(M.MIN_SIMILARITY),
    "tag_semantic_groups_strict": _groups(STRICT_SIMILARITY),
    "tag_groups_grown": _groups(M.MIN_SIMILARITY),
    "mapped_sessions": with_views(
        """SELECT sample_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM (
          SELECT DISTINCT sample_id, coalesce(canonical, tag) AS tag FROM fx_tagged LEFT JOIN rule_map USING (tag)) t
        GROUP BY sample_id""",
        **RULE_VIEWS,
    ),
    "frequent_itemsets": with_views("SELECT items, n FROM itemsets", recursive=True, **BASKETS),
    "frequent_pairs": with_views(
        """SELECT a.item AS tag_a, b.item AS tag_b, count(*) AS n FROM basket a JOIN basket b USING (sample_id)
        WHERE a.item < b.item GROUP BY ALL HAVING count(*) >= 40""",
        recursive=True,
        **BASKETS,
    ),
    "association_rules": with_views(
        "SELECT antecedent, consequent, round(confidence, 6) AS confidence FROM rules",
        recursive=True,
        **BASKETS,
    ),
    "association_rules_full": with_views(
        """SELECT antecedent, consequent, s.n, round(s.n * 1.0 / i.n, 6) AS confidence FROM (
          SELECT n, array_to_string(list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 0), '|') AS antecedent,
            array_to_string(list_filter(l, lambda x, i: (mask >> (i - 1)) & 1 = 1), '|') AS consequent
          FROM (SELECT n, l, unnest(range(1, (1 << len(l)) - 1)) AS mask
            FROM (SELECT n, string_split(items, '|') AS l FROM itemsets) t WHERE len(l) > 1) m) s
        JOIN itemsets i ON i.items = s.antecedent WHERE s.n * 1.0 / i.n >= 0.99""",
        recursive=True,
        **BASKETS,
    ),
    "association_pairs": with_views(
        """SELECT antecedent, consequent, round(n * 1.0 / s.n1, 6) AS confidence FROM (
          SELECT a.item AS antecedent, b.item AS consequent, count(*) AS n FROM basket a JOIN basket b USING (sample_id)
          WHERE a.item <> b.item GROUP BY ALL HAVING count(*) >= 40) p
        JOIN (SELECT item, n AS n1 FROM singles) s ON s.item = antecedent WHERE n * 1.0 / s.n1 >= 0.99""",
        recursive=True,
        **BASKETS,
    ),
    "tag_assoc_groups": with_views("SELECT tag, canonical FROM assoc", recursive=True, **BASKETS),
    "tag_mapping_final": with_views("SELECT tag, canonical FROM final_map", recursive=True, **PIPELINE),
    "tag_reduction": with_views(
        """SELECT 0 AS step, 'original' AS name, count(*) AS tags FROM frequency
        UNION ALL SELECT 1, 'frequency', count(*) FROM frequent
        UNION ALL SELECT 2, 'rule', count(DISTINCT canonical) FROM rule_map
        UNION ALL SELECT 3, 'semantic', count(DISTINCT canonical) FROM semantic_map
        UNION ALL SELECT 4, 'association', count(DISTINCT canonical) FROM final_map""",
        recursive=True,
        **PIPELINE,
    ),
    "tag_stats": with_views(
        """SELECT (SELECT count(*) FROM final_map) AS filtered_tags, (SELECT count(DISTINCT canonical) FROM final_map) AS final_tags,
          (SELECT count(*) FROM frequency) AS original_tags,
          (SELECT round(count(DISTINCT canonical) * 100.0 / count(*), 1) FROM final_map) AS ratio_pct,
          count(DISTINCT sample_id) AS records, count(*) AS kept_tags
        FROM (SELECT DISTINCT sample_id, canonical FROM fx_tagged JOIN final_map USING (tag)) k""",
        recursive=True,
        **PIPELINE,
    ),
    "apply_tag_mapping": with_views(
        "SELECT sample_id, string_agg(canonical, ',' ORDER BY pos) AS tags FROM cleaned GROUP BY sample_id",
        **_CLEANED,
    ),
    "clean_tag_records": f"""
        WITH spelled AS (SELECT doc_id AS sample_id, unnest([lang, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END,
            lang || '!', 'rare ' || doc_id, source]) AS tag, unnest([1, 2, 3, 4, 5]) AS pos FROM documents),
          often AS (SELECT tag, {LEXICAL_KEY} AS k FROM spelled GROUP BY tag HAVING count(*) >= 20),
          mapping AS (SELECT tag, min(tag) OVER (PARTITION BY k) AS canonical FROM often),
          firsts AS (SELECT sample_id, canonical, min(pos) AS pos FROM spelled JOIN mapping USING (tag) GROUP BY ALL)
        SELECT sample_id, string_agg(canonical, ',' ORDER BY pos) AS tags FROM firsts GROUP BY sample_id""",
    "tag_top20": with_views(
        "SELECT canonical, count(*) AS n FROM cleaned GROUP BY canonical ORDER BY n DESC, canonical LIMIT 20",
        **_CLEANED,
    ),
}
