"""Packing: token ids against the tokenizer itself, gapless sequences, even cost, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tagloom.llm import packing, queries

PIECES = st.sampled_from(
    ["Élan", "naïve,", "Straße", "ÀÿØ", "×", "÷a", "ªº", "µm", "\u00adx", "Ñandú!", "é\u0301", "The", "the,", "don't", "'S", "É", "é", "J̌", "Σας", "İ", "ﬁ", "K", "x\x01y", "\x01",
     "<|endoftext|>", "<|ENDOFTEXT|>", "1234", "a1b2.", "...", "\x1c", "\x85", "\xa0", " ", "日本語", "\U0001f600",
     "AbC!", "well-known;", "́", "…,", "ab…,"]
)


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, st.sampled_from(["", " ", "\n", "\t ", "\x0b", "\r\n"])), max_size=12))
def test_ids_are_the_tokenizers(pairs):
    text = "".join(a + b for a, b in pairs)
    coder = packing.encoder(queries.tokenizer_path(), 2)
    want = [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    (got,) = coder.encode([text.encode()])
    assert np.frombuffer(got, "<u4").tolist() == want


def test_other_tokenizers_take_no_short_way():
    import os

    path = os.path.join(os.path.dirname(queries.tokenizer_path()), "byte_bpe_50k.json")
    coder = packing.Encoder(path, 2)
    assert not coder.by_word and not coder.direct
    assert packing.encoder(queries.tokenizer_path(), 2).direct
    text = "The quick  brown fox,\n\tÉlan NAÏVE don't 12 x***"
    (got,) = coder.encode([text.encode()])
    assert np.frombuffer(got, "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=6), max_size=8))
def test_texts_of_one_batch_keep_apart(texts):
    texts = [" ".join(pieces) for pieces in texts]
    coder = packing.encoder(queries.tokenizer_path(), 2)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode([t.encode() for t in texts])]
    assert got == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_assign_fills_every_sequence(lengths):
    total = sum(lengths)
    capacities = [64] * (total // 64) + packing.powers_of_two(total % 64)
    placed, left = packing.assign(
        [(i, 0, n) for i, n in enumerate(lengths)], capacities, 1.0, 0.1
    )
    assert left == [] and sum(p[2] for p in placed) == total
    filled = defaultdict(int)
    for _, _, n, at, offset in placed:
        assert offset == filled[at]
        filled[at] += n
    assert [filled[k] for k in range(len(capacities))] == capacities


def test_descending_documents_go_to_the_cheapest_sequence():
    placed, _ = packing.assign([(0, 0, 60), (1, 0, 50), (2, 0, 10), (3, 0, 8)], [100, 100], 1.0, 0.0)
    assert [(p[0], p[3]) for p in placed] == [(0, 0), (1, 1), (2, 1), (3, 0)]


def texts():
    rnd = random.Random(2)
    words = ["alpha", "Beta,", "gamma.", "delta", "ümlaut", "epsilon-zeta", "42"]
    out = [None, "", " \n", "one"] + [
        " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 40, 300, 2000]))) for _ in range(300)
    ]
    return out + [" ".join(rnd.choice(words) for _ in range(30_000))]


def test_query_against_the_tokenizer(spark, path, tmp_path):
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    coder = packing.encoder(path, 2)
    want = {}
    for i, t, _ in rows:
        if i is not None:
            want[i] = [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, str(tmp_path)).collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            ids = np.array(want[doc][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"]) == (at, len(want[doc]))
            assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
            at += r["length"]
        assert at == len(want[doc])
    padded = 0
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded == 0


def test_empty_table_and_other_columns(spark, path):
    docs = spark.createDataFrame([("k", "a b", 1, "x")], "id string, text string, length int, ids string")
    found = packing.pack_documents(docs, path, id="id").collect()
    assert sorted((r["id"], r["start"], r["length"], r["offset"]) for r in found) == [
        ("k", 0, 2, 0),
        ("k", 2, 1, 0),
    ]
    assert packing.pack_documents(docs.limit(0), path, id="id").count() == 0


def test_a_repeated_run_gives_the_same_pieces(spark, path, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    again = spark.read.parquet(f"{tmp_path}/d")
    run = lambda: sorted(packing.pack_documents(again, path).collect())
    assert run() == run()
