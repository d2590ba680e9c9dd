"""The pipeline stage by stage against plain Python versions, on whole stage inputs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import packing, queries, quality, secrets
from tests.llm.test_minhash import brute as components
from tests.llm.test_mixing import shares
from tests.llm.test_quality import brute as measures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The input of every stage and the last one's output, each written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('pipeline')}/{name}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(table):
    return [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]


def test_columns(tables):
    for table in tables[1:-1]:
        assert table.dtypes == tables[0].dtypes


def holds(text):
    m = measures(text)
    part = lambda a, b: m[a] / m[b] if m[b] else 0.0
    m |= {
        "mean_word": part("word_chars", "n_words"),
        "symbol_ratio": part("n_symbols", "word_chars"),
        "stop_ratio": part("n_stop", "n_words"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "repeat_ratio": part("n_repeat_words", "n_words"),
    }
    return all(
        (r.least is None or m[r.measure] >= r.least) and (r.most is None or m[r.measure] <= r.most)
        for r in quality.RULES
    )


def test_quality_rules(tables):
    assert sorted(rows(tables[1])) == sorted(r for r in rows(tables[0]) if holds(r[1]))


def test_near_duplicates(tables):
    before = rows(tables[1])
    named = components([r[:2] for r in before], 5, 80)
    assert sorted(rows(tables[2])) == sorted(r for r in before if named[r[0]][1] == r[0])
    assert len(before) > tables[2].count() > 0


def test_secrets(tables):
    want = [
        (i, secrets.redact(t, secrets.spans(t), "[SECRET]") if t else t, *rest)
        for i, t, *rest in rows(tables[2])
    ]
    assert sorted(rows(tables[3])) == sorted(want)


def test_mixing(tables):
    before, after = Counter(rows(tables[3])), Counter(rows(tables[4]))
    assert set(after) <= set(before) and max(after.values()) <= 3
    sizes, taken, least = Counter(), Counter(), defaultdict(lambda: 10**9)
    for (_, text, _, source), n in before.items():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += size * n
        least[source] = min(least[source], size)
    for (_, text, _, source), n in after.items():
        taken[source] += n * len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    for source, target in shares(dict(sizes)).items():
        # Whole documents: the smallest one of the source may still be missing.
        assert target - 2 * least[source] - 100 <= taken[source] <= target + 1


def test_packing(tables):
    coder = packing.encoder(queries.tokenizer_path(), packing.END)
    want = Counter()
    for i, text, *_ in rows(tables[4]):
        want[i, coder.encode([(text or "").encode()])[0]] += 1
    pieces = defaultdict(list)
    for r in tables[5].collect():
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"]
    tokens = lambda some: Counter(np.frombuffer(b"".join(some), "<u4").tolist())
    for i in {i for i, _ in want}:
        whole = [ids for (k, ids), n in want.items() if k == i for _ in range(n)]
        assert tokens(whole) == tokens([ids for _, ids in pieces[i]])
        if len(whole) == 1:
            assert b"".join(ids for _, ids in sorted(pieces[i])) == whole[0]
    assert set(pieces) == {i for i, _ in want}


def test_run_gives_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, SF)
    assert got.dtypes == tables[5].dtypes
    total = lambda t: t.selectExpr("sum(length)").first()[0]
    assert total(got) == total(tables[5])
