"""Tagger and router answers: hand-made cases for every reading rule."""

import pytest

from tagloom.functions import responses as J
from tagloom.functions import routes

ARRAY = '[{"tag": "src8", "explanation": "e1"}, {"tag": "fr", "explanation": "e2"}]'
PAIRS = [("src8", "e1"), ("fr", "e2")]
GENERAL = [J.GENERAL_TAG]


def items(n):
    return "[" + ", ".join(f'{{"tag": "t{i}", "explanation": "e"}}' for i in range(n)) + "]"


@pytest.mark.parametrize(
    "text, tags",
    [
        (ARRAY, ["src8", "fr"]),
        (f"```json\n{ARRAY}\n```", ["src8", "fr"]),
        ("", []),
        (None, []),
        ("no structure here", []),
        ("[]", []),
        ("  " + ARRAY, ["src8", "fr"]),
        # A valid list without tags is final; an invalid one is searched for tag values.
        ('[{"name": "a"}]', []),
        ('[{"tag": "a"}] and {"tag": "b"}', ["a", "b"]),
        ('[{"tag": "a"}, {"tag": "b', ["a"]),
        ('[3, "x", {"tag": " a "}]', [" a "]),
        (items(7), ["t0", "t1", "t2", "t3", "t4"]),
        ("[{'tag': 'a'}]", []),
        ('[{"tag": "a", "tag": "b"}]', ["b"]),
    ],
)
def test_basic(column, text, tags):
    assert column([text], J.tags_basic) == [tags]


@pytest.mark.parametrize(
    "text, tags",
    [
        (ARRAY, ["src8", "fr"]),
        ('{"tag": " a ", "explanation": "e"}', ["a"]),
        ('{"tag": "  "}', []),
        ('[{"tag": " "}, {"tag": "b "}]', ["b"]),
        ('x {"tag": "a"} y {"tag":"  "}', ["a"]),
        (items(6), ["t0", "t1", "t2", "t3", "t4"]),
    ],
)
def test_strict(column, text, tags):
    assert column([text], J.tags_strict) == [tags]


@pytest.mark.parametrize(
    "text, tags",
    [
        (ARRAY, PAIRS),
        (f"first [1, 2] then {ARRAY}", PAIRS),
        ("```json\n" + ARRAY + "\n```", PAIRS),
        ("", GENERAL),
        ("no structure here", GENERAL),
        # The last bracketed span decides, and it ends at the first closing bracket.
        (ARRAY + " [see 1]", GENERAL),
        ('[{"tag": "a", "explanation": "list [x] here"}]', GENERAL),
        ('[{"tag": "a"}]', GENERAL),
        ("Tag: a\nExplanation: b", [("a", "b")]),
    ],
)
def test_explained(column, text, tags):
    assert column([text], J.tags_explained) == [tags]


@pytest.mark.parametrize(
    "text, tags",
    [
        (ARRAY, PAIRS),
        # A valid list without usable items is final here.
        ('[{"tag": "a"}]', []),
        ("[1] [oops", []),
        (ARRAY[1:-1].replace("}, {", "} {"), PAIRS),
        ('{"tag": "a", "explanation": "b"} {"tag": "c", "explanation": oops}', [("a", "b")]),
        ('{"tag": "c", "explanation": oops}', []),
        ("no structure here", GENERAL),
    ],
)
def test_objects(column, text, tags):
    assert column([text], J.tags_objects) == [tags]


def test_objects_cap(column):
    assert [len(t) for t in column([items(8)], J.tags_objects)] == [5]
    assert [len(t) for t in column([items(8)], lambda c: J.tags_objects(c, cap=None))] == [8]
    lines = "\n".join(f"tag: t{i}\nexplanation: e" for i in range(8))
    assert [len(t) for t in column([lines], J.tags_from_lines)] == [5]
    assert [len(t) for t in column([lines], lambda c: J.tags_from_lines(c, None))] == [8]


@pytest.mark.parametrize(
    "text, tags",
    [
        ("Tag: a\nExplanation: b\nTag: c\nd", [("a", "b"), ("c", "d")]),
        ('1. "Tag": "a"\n\n   why not', [("a", "why not")]),
        ("Tag: a\nExplanation:\nlate", [("a", "late")]),
        ("Tag: a\nfirst\nExplanation: second\nthird", [("a", "second")]),
        ("Tag: a\nTag: b\nExplanation: c", [("b", "c")]),
        ("Explanation: lost\nTag: a", GENERAL),
        ("tag without colon\nTag:\nx", GENERAL),
        ("Tag: it's: \"x\"\ny", [("its: x", "y")]),
        # The tag test comes first, also on a line that explains.
        ("Tag: a\nExplanation of tag: b", GENERAL),
    ],
)
def test_lines(column, text, tags):
    assert column([text], J.tags_from_lines) == [tags]


@pytest.mark.parametrize(
    "text, tags, success",
    [
        (ARRAY, PAIRS, True),
        ('{"tag": "a", "explanation": "b"}', [("a", "b")], True),
        # Equal length: the first span wins. A longer invalid span leads to the loose values.
        ("[1] {}", [(None, None)], True),
        ('[{"tag": "a", "explanation": "say \\"x\\""}', [("a", 'say "x"')], True),
        ('{"tag": "a", "explanation": "b",}', [("a", "b")], True),
        # The first closing bracket ends the span, the whole answer is valid all the same.
        ('[{"x": [1], "tag": "a"}, 2]', [("a", None), (None, None)], True),
        ("nothing", [J.ERROR_TAG], False),
        ("", [J.ERROR_TAG], False),
        ("7", [(None, None)], True),
    ],
)
def test_longest(column, text, tags, success):
    assert column([text], lambda c: J.tags_longest(c)["tags"]) == [tags]
    assert column([text], lambda c: J.tags_longest(c)["success"]) == [success]


def test_loose_explanation_survives_long_text(column):
    text = '{"tag": "a", "explanation": "' + "x\\\\y " * 50_000 + '" oops}'
    assert column([text], lambda c: J.tags_longest(c)["success"]) == [False]


@pytest.mark.parametrize(
    "text, tags",
    [
        (ARRAY, PAIRS),
        (ARRAY + " trailing", PAIRS),
        # A list that closes but is no JSON ends the search.
        ('[{"tag": "a", "explanation": "b"} oops] {"tag": "c", "explanation": "d"}', []),
        # A list that never closes is searched for whole objects.
        ('[{"tag": "a", "explanation": "b"}, {"tag": "c", "expl', [("a", "b")]),
        ("x " + ARRAY, PAIRS),
        # Balanced scan: other key order behind the tag, nested objects, broken ones skipped.
        ('{"tag":"a", "more": {"k": 1}, "explanation": "b"}', [("a", "b")]),
        ('{"tag": oops} {"tag": "c", "n": 1}', [("c", None)]),
        ('{"tag": "a", "n": 1} {"tag": "b", "n": {', [("a", None)]),
        ('{"n": {"tag": "in", "x": 1}}', [("in", None)]),
        ("", []),
    ],
)
def test_evaluated(column, text, tags):
    assert column([text], J.tags_evaluated) == [tags]


def test_balanced_prefix(column):
    texts = ["[a[b]c] d]", "[[x]", "[]", "no", "[a]"]
    assert column(texts, J.balanced_prefix) == ["[a[b]c]", None, "[]", None, "[a]"]


def test_comma_and_string(column):
    assert column([" a, b ,, c,d,e,f", "", None], J.tags_comma) == [list("abcde"), [], []]
    texts = ["\"a, b,,c,d,e,f\"", " 'a' ", " x　,\ty", "''", None]
    assert column(texts, J.tags_string) == [list("abcdef"), ["a"], ["x", "y"], [], []]


def test_echo_and_success(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ask: hi  there ", "ask: hi"), ("other", "ask")], "r string, p string")
    got = [r[0] for r in rows.select(J.without_echo(F.col("r"), F.col("p"))).collect()]
    assert got == ["there", "other"]


@pytest.mark.parametrize(
    "text, single, lenient, multi",
    [
        ('{"best_model": "m08"}', "m08", "m08", ["m08"]),
        ('```JSON\n{"best_model": "m08"}\n```', "m08", "m08", ["m08"]),
        ("{'best_model': 'm07'}", "m07", "m07", []),
        (' {"best_model": "m01"} {"best_model": "m02"}', "m01", "m01", ["m01", "m02"]),
        ('{"best_model": "M06"', "M06", "M06", ["M06"]),
        ('{"best_model": "', routes.GENERATION_ERROR, "", []),
        ('{"Best_Model": "x", "k": 1}', "x", "x", ["x"]),
        ('{"why": "z", "best_model": " x "}', "x", "x", ["x"]),
        ("best_model: m03, sure", "m03", "m03", []),
        ("The best model is: m11.", routes.GENERATION_ERROR, "m11", []),
        ("\n{\nAnswer: 'm02'\n", routes.GENERATION_ERROR, "m02", []),
        ("Answer: Model: m05", routes.GENERATION_ERROR, "m05", []),
        ("...\nm04", routes.GENERATION_ERROR, "m04", []),
        ('{"best_model": ""}', "", "", []),
        ("", routes.GENERATION_ERROR, "", []),
        (None, routes.GENERATION_ERROR, "", []),
    ],
)
def test_routes(column, text, single, lenient, multi):
    assert column([text], routes.route_lenient) == [lenient]
    assert column([text], routes.route_single) == [single]
    assert column([text], routes.route_multi) == [multi]
