"""Secret scans: the plain patterns against a literal reading of them, the lexer, redaction."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from tagloom.llm import queries, secrets


def plain(text):
    """Leftmost non-overlapping matches by kind, failing ones dropped."""
    found = []
    target = "|".join(
        "".join(f"[{c.lower()}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")
    )
    api = "[aA][pP][iI]_?[kK][eE][yY]"
    rule = rf"""({target}|{api})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(rule, text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text or ""):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text or ""):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def base(text):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in secrets.spans(text) if s["kind"] != "literal"]


PIECES = st.sampled_from(
    ["password", "Token", "API_KEY", "apikey", "ſecret", "secret", "AKIA", "A" * 16, "0a" * 12, "=", ":", " ",
     "'", '"', "\n", "é", "abc123", "x", "-", "+", "==", "//", "`", "\\", "key", "\U0001f600"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_plain_patterns(text):
    assert base(text) == plain(text)
    for s in secrets.spans(text):
        assert 0 <= s["start"] <= s["value_start"] < s["end"] <= len(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('key = "aB3dE5gH7jK9"; password = key', ["aB3dE5gH7jK9"]),
        ('k1="Zk39dkLw02x"\nk2=k1\nclientSecret=k2', ["Zk39dkLw02x"]),
        ("conf['api-key'] => s3cr3tV4lue99", ["s3cr3tV4lue99"]),
        ("client_secret := 'Zx81kd02mm' + \"abcD12\"", ["Zx81kd02mm", "abcD12"]),
        ("a = b\nb = a\nsecretKey = a", []),
        ('public_key = "MIIBIjANBgkqh"', []),
        ("db_pwd: ${DB_PASSWORD}", []),
        ("Note: the keynote = a talk about locks", []),
        ('if pwd == "Qw3rty!!x9": pass', []),
        ("see https://example.org/key", []),
    ],
)
def test_literals(text, want):
    found = [text[s["start"] : s["end"]] for s in secrets.spans(text) if s["kind"] == "literal"]
    assert found == want


def test_long_texts_take_linear_time():
    for text in ("=" * 300_000, "a=" * 150_000, '"' * 300_000, "key=b+" * 60_000, " :" * 150_000,
                 "password " + " " * 300_000, "k='" * 100_000, "a" * 400_000 + "=b"):
        secrets.spans(text)


def test_query_and_redaction(spark, tmp_path):
    texts = [None, "", "clean text", 'é token = "0123456789abcdef01234567" x', "pwd=`Qw3rty!!x9`"]
    texts += ["AKIA" + "Q" * 16, "AKIA" + "Q" * 16, "w " * 200_000 + "password=abcdef1"]
    rows = [(i if i else None, t, "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        row, want = got[i if i else None], plain(text)
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [
            sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")
        ]
    assert got[4]["spans"] == "literal:5:15"
    clean = {r["doc_id"]: tuple(r) for r in secrets.redact_secrets(docs).collect()}
    assert clean[None] == (None, None, "mine") and clean[2][1] == "clean text"
    assert clean[3][1] == 'é token = "[SECRET]" x' and clean[4][1] == "pwd=`[SECRET]`"
    assert secrets.find_secrets(docs.limit(0)).count() == 0


PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow9K2\nQ8d/x+1==\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("DB_PWD = 'MyS3cr3t!Pass9'", ["MyS3cr3t!Pass9"]),
        ("DB_PWD = 'Test8fK2mQ4z'", ["Test8fK2mQ4z"]),
        ("client_pwd = 'changeme'", []),
        ("client_pwd = 'your-password-here'", []),
        ("client_pwd = 'some password'", []),
        ("passphrase = 'correct horse battery staple 9'", ["correct horse battery staple 9"]),
        ("auth_header_name = 'two words here'", []),
        ('pwd = """Zk39dkLw02x\nQw8rty77"""', ["Zk39dkLw02x\nQw8rty77"]),
        ("a:\n  pwd: |\n    Zk39dkLw02x\n    Qw8rty77\n  next: 1", ["Zk39dkLw02x\n    Qw8rty77"]),
        (f"text\n{PEM}\nmore", [PEM]),
        (f'KEY_PEM = """{PEM}"""', [PEM]),
    ],
)
def test_whole_literals(text, want):
    assert [text[s["start"] : s["end"]] for s in secrets.spans(text) if s["kind"] == "literal"] == want
    left = secrets.redact(text, secrets.spans(text), "[SECRET]")
    assert not any(w in left for w in want)


def test_open_blocks_take_linear_time():
    for text in ('pwd = """' * 40_000, "pwd: |\n" * 40_000, "-----BEGIN PRIVATE KEY-----" * 10_000,
                 "pwd: |\n  a\n" * 30_000, ("a=" + "'" * 3) * 60_000, ("=" + '"' * 3 + " ") * 60_000):
        begin = time.process_time()
        secrets.spans(text)
        assert time.process_time() - begin < 10


def test_long_chains_and_many_keys_take_linear_time():
    started = time.process_time()
    text = "\n".join(f"token{i} = token{i + 1}" for i in range(40_000)) + '\ntoken40000 = "Zx81kQ93vLm2"\n'
    found = secrets.spans(text)
    assert "Zx81kQ93vLm2" in {text[f["value_start"] : f["end"]].strip("\"'") for f in found}
    block = "-----BEGIN PRIVATE KEY-----\nMIIEvQIBADANBg\n-----END PRIVATE KEY-----\n"
    text = "".join(f'{block}db_pwd{i} = "q8Zr{i}Tk4wX9"\n' for i in range(8_000))
    kinds = [f["name"] for f in secrets.spans(text)]
    assert kinds.count("private key") == 8_000 and len(kinds) == 16_000
    assert time.process_time() - started < 30
