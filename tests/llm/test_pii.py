"""Personal data: the rules against a literal reading of them, the trees, thresholds, redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm import pii, queries


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """Leftmost non-overlapping matches by kind, failing ones dropped."""
    found, text = [], text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for k, (kind, rule, holds) in enumerate(rules):
        for m in re.finditer(rule, text):
            if holds(m[0]):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


PIECES = ["a", "é", "\U0001f600", "@", ".", "-", "_", "+", " ", "1", "12", "255", "256", "0", "(", ")", "x.y",
          "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (269) 555-3296", "a.b@c-d.e", "10.0.0.255", "\n", "%"]


def random_texts(n=1500):
    rnd = random.Random(8)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def proposed(spark):
    texts = [None, "", *random_texts()]
    texts += ["1" * 30_000, "11 a " * 3_000, "a@" * 20_000, "+" * 20_000, "+1" + " " * 20_000, "x" * 100_000 + "@b.c"]
    texts += ["a.b@c.d " * 2_000, "1." * 20_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, text string, base string")
    return pii.propose(docs).repartition(4).cache()


def test_rules(proposed):
    rows = pii.select(proposed, pii.Model()).collect()
    assert len(rows) > 1500
    for r in rows:
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["personal"]]
        assert got == plain(r["text"]), r["text"][:200]


def test_offsets(spark):
    rnd = random.Random(2)
    cases = [[rnd.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    rows = spark.createDataFrame([(c,) for c in cases], "v array<long>")
    rows = rows.withColumn("b", pii._before_blocks("v")).select(pii._offsets("v", "b").alias("o"))
    for c, r in zip(cases, rows.collect(), strict=True):
        assert r["o"] == [sum(c[:k]) for k in range(len(c))]


def corpus(spark):
    """Numbers with and without their country code, and harmless digits."""
    rnd = random.Random(3)
    number = lambda: f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    rows = []
    for i in range(600):
        rows.append((i, f"word {i % 7}.{i % 5} text {rnd.randint(1900, 2020)} call +1 {number()} now"))
    rows += [(1000 + i, f"ring {number()} today") for i in range(20)]
    rows += [(2000 + i, f"in {rnd.randint(1000, 9999)} there were {i} of 10 000 000 000 things") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trees_add_what_looks_alike(spark):
    proposed = pii.propose(corpus(spark)).cache()
    model = pii.fit(proposed)
    assert model.trees and model.least
    rows = {r["doc_id"]: r for r in pii.select(proposed, model).collect()}
    learned = {i for i, r in rows.items() if any(s["kind"] == "learned" for s in r["personal"])}
    assert learned == set(range(1000, 1020))
    for i in learned:
        (span,) = rows[i]["personal"]
        assert rows[i]["text"][span["start"] : span["end"]].endswith(rows[i]["text"][-15:-6])


def test_expression_is_the_model(spark):
    proposed = pii.propose(corpus(spark)).cache()
    model = pii.fit(proposed)
    each = proposed.select(F.explode("personal.proposals").alias("c")).distinct()
    rows = each.select("c", model.selects(F.col("c")).alias("s")).collect()
    for r in rows:
        cell = r["c"].asDict()
        least = model.least.get(cell["generator"])
        assert r["s"] == (least is not None and model.score(cell) >= least)


def test_query_and_redaction(spark, tmp_path):
    texts = [None, "", "clean", "é a.b@c.de x 10.0.0.1", "card 4111 1111 1111 1111, +1 (269) 555-3296.", "a.b@c.de"]
    rows = [(i or None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(texts[r["doc_id"] or 0])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
            sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")
        ]
    found = pii.select(pii.propose(docs), pii.Model())
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert clean == {
        None: None, 1: "", 2: "clean", 3: "é [EMAIL] x [IP]", 4: "card [CARD], [PHONE].", 5: "[EMAIL]",
    }
    assert pii.propose(docs.limit(0)).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([("a@b.c",)], "text string")
    plan = pii.propose(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
