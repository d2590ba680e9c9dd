"""Tag normalization: keys, mapping, similarity, components, associations."""

import itertools
import math
import random

import pytest

from tagloom.functions.lexical import lexical_key, terms_of
from tagloom.operators import association as A
from tagloom.operators import components as C
from tagloom.operators import normalize as N
from tagloom.operators import similarity as M
from tagloom.plans.normalization import normalize_tags
from tagloom.session import bounded_side, small_side


def test_lexical_key(column):
    tags = ["Data-Science", "C++", "C#", "!!", "ing", "red", "gas", "cats", "Writing  Codes", "Éclairs_x"]
    keys = ["data science", "c", "c", "", "", "r", "gas", "cat", "writ code", "éclairs_x"]
    assert column(tags, lexical_key) == keys


def test_terms(column):
    got = column(["the art of War", "a b", "data Data x1"], terms_of)
    assert got == [["art", "war", "art war"], [], ["data", "data", "x1", "data data", "data x1"]]


def _tags(spark, names):
    return spark.createDataFrame([(n,) for n in names], "tag string")


def _mapping(df):
    return {r["tag"]: r["canonical"] for r in df.collect()}


def test_rule_mapping_takes_smallest(spark):
    got = _mapping(N.rule_mapping(_tags(spark, ["cats", "Cat", "cat!", "dog", "#", "@"])))
    assert got == {"cats": "Cat", "Cat": "Cat", "cat!": "Cat", "dog": "dog", "#": "#", "@": "#"}


def test_compose_and_apply(spark):
    mapping = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "c")], "tag string, canonical string")
    regroup = spark.createDataFrame([("x", "c")], "tag string, canonical string")
    assert _mapping(N.compose(mapping, regroup)) == {"a": "c", "b": "c", "c": "c"}
    records = spark.createDataFrame(
        [(1, ["b", "c", "a", "zz"]), (2, ["zz"]), (3, ["c", "a"])], "sample_id long, tags array<string>"
    )
    got = {r[0]: r[1] for r in N.apply_mapping(N.tag_occurrences(records), mapping).collect()}
    assert got == {1: "x,c", 3: "c,x"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(90)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(64)] + [("hub", n) for n in nodes[:30]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for order in range(2):
        rng.shuffle(edges)
        rows = [(a, b) if order else (b, a) for a, b in edges]
        got = C.connected_components(spark.createDataFrame(rows, "src string, dst string"))
        assert {r["node"]: r["component"] for r in got.collect()} == {n: find(n) for n in parent}


def test_components_without_edges(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert C.connected_components(empty).count() == 0
    assert _mapping(C.group_by_components(_tags(spark, ["b", "a"]), empty)) == {"a": "a", "b": "b"}


def _brute_vectors(tags, column, max_terms=1000):
    terms = dict(zip(tags, column(tags, terms_of)))
    total, df = {}, {}
    for words in terms.values():
        for w in words:
            total[w] = total.get(w, 0) + 1
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    kept = sorted(total, key=lambda w: (-total[w], w))[:max_terms]
    vectors = {}
    for tag, words in terms.items():
        raw = {w: words.count(w) * (math.log((1 + len(tags)) / (1 + df[w])) + 1) for w in words if w in kept}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        if raw:
            vectors[tag] = {w: v / norm for w, v in raw.items()}
    return vectors


def _cosine(a, b):
    return sum(v * b.get(w, 0.0) for w, v in a.items())


@pytest.mark.parametrize("max_terms", [1000, 12])
def test_similarity_equals_all_pairs(spark, column, max_terms):
    rng = random.Random(11)
    words = ["data", "code", "math", "text", "news", "game", "law", "bio", "art", "web"]
    weights = [40, 20, 10, 8, 6, 4, 3, 2, 2, 1]
    tags = sorted({" ".join(rng.choices(words, weights, k=rng.randint(1, 5))) for _ in range(160)} | {"the", "a of"})
    vectors = _brute_vectors(tags, column, max_terms)
    frame = M.tag_vectors(_tags(spark, tags), max_terms=max_terms).checkpoint()
    for r in M.tag_tfidf(frame).collect():
        assert r["weight"] == pytest.approx(vectors[r["tag"]][r["term"]], abs=1e-9)
    for bound in (0.05, 0.35, 0.6, 0.9):
        all_pairs = {
            (a, b) for a, b in itertools.combinations(sorted(vectors), 2)
            if round(_cosine(vectors[a], vectors[b]), 12) >= bound
        }
        named = {}
        for t in sorted(vectors):
            shape = tuple(sorted((w, round(v, 9)) for w, v in vectors[t].items()))
            named[t] = named.get(shape) or named.setdefault(shape, t)
        copies = {(named[t], t) for t in vectors if named[t] != t}
        wanted = {(a, b) for a, b in all_pairs if named[a] == a and named[b] == b} | copies
        got = {(r["src"], r["dst"]) for r in M.similar_pairs(frame, bound, salts=3).collect()}
        assert got == wanted
        parent = {t: t for t in tags}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in all_pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        groups = M.semantic_groups(_tags(spark, tags), bound, max_terms=max_terms)
        assert _mapping(groups) == {t: find(t) for t in tags}


def _brute_itemsets(baskets, support):
    found = {}
    items = sorted(set().union(*baskets))
    for k in range(1, len(items) + 1):
        level = {}
        for s in itertools.combinations(items, k):
            n = sum(set(s) <= b for b in baskets)
            if n >= support:
                level[s] = n
        if not level:
            break
        found.update(level)
    return found


@pytest.mark.parametrize("support", [2, 5, 147])
def test_itemsets_and_rules(spark, support):
    rng = random.Random(5)
    baskets = [set(rng.choices("abcdef", [9, 7, 5, 3, 2, 1], k=rng.randint(1, 4))) for _ in range(147)]
    baskets = [b | {"g"} if "a" in b else b for b in baskets]
    frame = spark.createDataFrame([(sorted(b),) for b in baskets], "items array<string>")
    itemsets = A.frequent_itemsets(frame, support)
    brute = _brute_itemsets(baskets, support)
    assert {tuple(r["items"]): r["n"] for r in itemsets.collect()} == brute
    rules = {
        (tuple(x for x in s if x != c), c)
        for s, n in brute.items() if len(s) > 1
        for c in s if n / brute[tuple(x for x in s if x != c)] >= 0.9
    }
    got = {(tuple(r["antecedent"]), r["consequent"]) for r in A.association_rules(itemsets, 0.9).collect()}
    assert got == rules
    pairs = {(r["antecedent"], r["consequent"]) for r in A.association_pairs(itemsets, 0.9).collect()}
    assert pairs == {(a[0], c) for a, c in rules if len(a) == 1}


@pytest.mark.parametrize(("support", "confidence"), [(2, 0.5), (5, 0.9), (10, 0.0), (147, 0.9)])
def test_rules_in_full(spark, support, confidence):
    rng = random.Random(6)
    baskets = [set(rng.choices("abcdef", [9, 7, 5, 3, 2, 1], k=rng.randint(1, 4))) for _ in range(147)]
    baskets = [b | {"g", "h"} if "a" in b else b for b in baskets]
    frame = spark.createDataFrame([(sorted(b), 1) for b in baskets], "items array<string>, n int")
    brute = _brute_itemsets(baskets, support)
    rules = {
        (tuple(x for x in s if x not in c), c, n, n / brute[tuple(x for x in s if x not in c)])
        for s, n in brute.items()
        for k in range(1, len(s))
        for c in itertools.combinations(s, k)
        if n / brute[tuple(x for x in s if x not in c)] >= confidence
    }
    got = A.association_rules_full(A.frequent_itemsets(frame, support), confidence).collect()
    assert len(got) == len(rules)
    assert {(tuple(r["antecedent"]), tuple(r["consequent"]), r["n"], r["confidence"]) for r in got} == rules


def _brute_groups(baskets, support, confidence):
    group = {x: x for b in baskets for x in b}
    brute = _brute_itemsets(baskets, support)
    ties = [
        s for s, n in brute.items() if len(s) > 1
        and any(n / brute[tuple(x for x in s if x != c)] >= confidence for c in s)
    ]
    for _ in group:
        for s in ties:
            low = min(group[x] for x in s)
            group |= {x: low for x in s}
    return group


@pytest.mark.parametrize("seed", range(6))
def test_groups_equal_those_of_all_rules(spark, seed):
    """With and without the shortcut by pair counts; links it gives are always those of rules."""
    rng = random.Random(seed)
    support, confidence = rng.choice([(4, 0.9), (6, 0.97), (3, 1.0)])
    baskets = [set(rng.choices("abcdefg", [9, 7, 5, 4, 3, 2, 1], k=rng.randint(1, 5))) for _ in range(120)]
    if seed % 2:
        baskets = [b | {"z"} if {"b", "c"} & b else b for b in baskets]
    if seed > 3:
        baskets = [b | {"y"} for b in baskets]  # a tag of every record ties all
    records = spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(baskets)], "sample_id long, tags array<string>")
    mapping = spark.createDataFrame([(x, x) for x in sorted(set().union(*baskets))], "tag string, canonical string")
    want = _brute_groups(baskets, support, confidence)
    got = A.association_groups(
        N.tag_occurrences(records), mapping, min_support=support, min_confidence=confidence
    )
    assert _mapping(got) == want
    frame = spark.createDataFrame([(sorted(b),) for b in baskets], "items array<string>")
    links = A.pair_links(*A._counts(frame, support), support, confidence).collect()
    assert all(want[r["src"]] == want[r["dst"]] for r in links)
    if seed > 3:
        assert {r["dst"] for r in links} >= set(want) - {"y"} - {x for x in want if want[x] == x != min(want)}


def test_too_few_records_have_no_rules(spark):
    records = spark.createDataFrame([(i, ["a", "b"]) for i in range(5)], "sample_id long, tags array<string>")
    mapping = spark.createDataFrame([("a", "a"), ("b", "b")], "tag string, canonical string")
    occurrences = N.tag_occurrences(records)
    assert _mapping(A.association_groups(occurrences, mapping)) == {"a": "a", "b": "b"}
    assert _mapping(A.association_groups(occurrences, mapping, min_support=5)) == {"a": "a", "b": "a"}


def test_pipeline_invariants(spark):
    rng = random.Random(1)
    words = ["Cats", "cat", "dog walking", "dog walk", "sun", "moon base", "moon", "red car"]
    records = spark.createDataFrame(
        [(i, rng.choices(words, k=3)) for i in range(200)], "sample_id long, tags array<string>"
    )
    occurrences = N.tag_occurrences(records)
    result = normalize_tags(occurrences, min_similarity=0.5, min_support=150)
    for mapping in result.steps().values():
        pairs = _mapping(mapping)
        assert all(c <= t and pairs[c] == c for t, c in pairs.items())
    assert _mapping(result.semantic)["moon base"] == "moon"


def test_empty_vocabulary(spark):
    records = spark.createDataFrame([(1, ["a"])], "sample_id long, tags array<string>")
    occurrences = N.tag_occurrences(records)
    final = normalize_tags(occurrences).final
    assert final.count() == 0
    stats = N.normalization_stats(occurrences, final).first()
    assert (stats["original_tags"], stats["filtered_tags"], stats["ratio_pct"]) == (1, 0, None)


def test_broadcast_only_within_bounds(spark, monkeypatch):
    import tagloom.session as session

    table = _tags(spark, ["a", "b"])
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small_side(table)) and hinted(bounded_side(table, 10))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 5)
    assert not hinted(small_side(table)) and not hinted(bounded_side(table, 10**9))


def test_grown_components_equal_those_from_scratch(spark):
    rnd = random.Random(11)
    for n_old, n_new in ((0, 5), (30, 0), (40, 8), (60, 40)):
        pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(n_old + n_new)]
        edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
        labels = C.connected_components(edges(pairs[:n_old]))
        grown = C.extend_components(labels, edges([*pairs[n_old:], *pairs[n_old:], (None, 3), (3, None)]))
        got = {(r["node"], r["component"]) for r in grown.collect()}
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            if a != b:
                a, b = sorted((root(a), root(b)))
                parent[b] = a
        assert got == {(x, root(x)) for x in list(parent)}
