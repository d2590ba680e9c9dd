"""Quality rules: measures against a plain Python version, edge cases, one projection."""

import re

import pytest

from tagloom.llm import quality

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c",
    "a b c a b c",
    "a a a a",
    "x y\nx y\n\nx y \nz",
    "The the OF of # $ | é\x0bü\x1cq",
    "p q r s p q r t p q",
    "\n".join(["same line here"] * 40),
    " ".join(f"w{i % 997}" for i in range(30_000)),
    " ".join(f"w{i}" for i in range(30_000)),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_stop": sum(w.lower() in quality.STOP_WORDS for w in words),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b c", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_measures_match_brute_force(docs):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        got = row["measures"].asDict()
        want = brute(row["text"])
        assert {k: got[k] for k in want} == want, row["doc_id"]
        assert row["n_words"] in ("x", None)  # the caller's own column


def test_kept_rows_have_their_own_columns(docs):
    rules = (quality.Rule("some", "n_words", least=3, most=10),)
    kept = quality.keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(
        t for t in [*TEXTS, "a b c"] if 3 <= brute(t)["n_words"] <= 10
    )


def test_failed_rules_are_named(docs):
    rows = {r["doc_id"]: r["measures_failed"] for r in quality.judge(docs).collect()}
    assert rows[0] == ["few_words", "word_length", "stop_words"]
    assert rows[10] == ["repeats", "stop_words", "dup_lines"]


def test_empty_table(docs):
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_one_projection(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Aggregate", "Join"))


def test_long_texts_and_other_languages_stay(spark):
    long_text = " ".join(f"the word{i} of" for i in range(340_000))
    other = " ".join(f"слово{i} ещё" for i in range(60))
    rows = [(1, long_text, "en"), (2, other, "ru"), (3, other, "en"), (4, other, None), (5, "x", "ru"), (6, other, "de-AT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, lang="lang").select("doc_id").collect()) == [1, 2, 4]
    assert [r["doc_id"] for r in quality.keep_good(docs).select("doc_id").collect()] == [1]
