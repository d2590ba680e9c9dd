"""Secrets in source and configuration text, found by what they are assigned to.

A small lexer reads every text once into pairs of a target name and a literal: ``name = "x"``,
``name: x``, ``"name": "x"``, ``name := 'x'``, ``map["name"] => x``. Constants are propagated: in
``key = "x"; password = key`` the literal counts for both names. A literal is a secret if its most
sensitive name and its own look reach the threshold together. Three plain patterns (assignments to
well-known words, access keys, long hexadecimal runs) are found besides and always stay; a literal
inside one of them isn't reported again.

Every text is read whole, in time linear in its length; rows are independent of each other.

Defined results: a NULL or empty text has no spans. Repeated rows get equal spans. Further columns
are kept. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.tables import whole_texts

# The plain patterns, in the order in which spans of equal start are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_LEAST = 6

# Weights of the words of a target name; the words are the parts of snake_case and camelCase.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9,
    "secret": 1.0, "secrets": 0.9, "credential": 0.9, "credentials": 0.9, "token": 0.9,
    "apikey": 1.0, "privatekey": 1.0, "accesskey": 0.9, "bearer": 0.8, "auth": 0.6,
    "authorization": 0.7, "signature": 0.4, "cookie": 0.5, "session": 0.4, "pin": 0.4,
    "salt": 0.4, "key": 0.5, "private": 0.4, "api": 0.3, "access": 0.3, "client": 0.1,
    "encryption": 0.4, "signing": 0.4, "master": 0.2, "admin": 0.1, "db": 0.1,
}
NAME_PENALTIES = {
    "public": 0.6, "name": 0.6, "id": 0.4, "file": 0.6, "path": 0.6, "dir": 0.6, "url": 0.6,
    "uri": 0.6, "length": 0.8, "size": 0.8, "count": 0.8, "type": 0.8, "field": 0.6,
    "label": 0.8, "hint": 0.8, "policy": 0.8, "header": 0.5, "prefix": 0.6, "column": 0.6,
    "primary": 0.6, "foreign": 0.6, "sort": 0.6, "index": 0.6, "expires": 0.8, "ttl": 0.8,
}
PLACEHOLDER = re.compile(
    r"x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w*\)?s|(?:process\.env|os\.environ|getenv)\b.*",
    re.IGNORECASE | re.ASCII,
)
# A phrase of whole words of which one is a sign of a placeholder, and no digits or odd marks.
PLACEHOLDER_WORDS = frozenset(
    "your my the some change replace insert dummy sample example test none null true false undefined "
    "todo default changeme placeholder".split()
)
_PHRASE = re.compile(r"[A-Za-z]+(?:[ _.-]?[A-Za-z]+)*[0-9]{0,3}", re.ASCII)
# Names whose values may be phrases of several words.
PHRASE_NAMES = frozenset("passphrase password passwd pwd passcode mnemonic seedphrase".split())
THRESHOLD = 1.2

_OPERATOR = re.compile(r":=|=>|[=:]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
_TRIPLE = re.compile(r'"""((?:[^"\\]|\\.|"(?!""))*)"""|\'\'\'((?:[^\'\\]|\\.|\'(?!\'\'))*)\'\'\'', re.DOTALL)
# A YAML block scalar: a mark at the line's end, then lines that are empty or indented further.
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\r?\n")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*(?![\w(\[])", re.ASCII)
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.?)?[ \t]*")


def _target(text: str, end: int) -> str:
    """The name that ends before an operator, without quotes and subscripts; may be empty."""
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"'`]":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME_CHAR:
        start -= 1
    return text[start:end].strip(".-")


def _block(text: str, name_at: int, at: int) -> tuple[int, int] | None:
    """The indented lines of a YAML block scalar whose mark is at ``at``."""
    if not (mark := _BLOCK.match(text, at)):
        return None
    line = text.rfind("\n", 0, name_at) + 1
    indent = len(text[line:name_at]) - len(text[line:name_at].lstrip(" "))
    start = end = here = mark.end()
    while here < len(text):
        stop = text.find("\n", here)
        stop = len(text) if stop < 0 else stop
        row = text[here:stop]
        if row.strip():
            if len(row) - len(row.lstrip(" ")) <= indent:
                break
            start = here + len(row) - len(row.lstrip(" ")) if end == mark.end() else start
            end = here + len(row.rstrip())
        here = stop + 1
    return (start, end) if end > mark.end() else None


def private_keys(text: str) -> list[tuple[int, int]]:
    """The PEM blocks of private keys; one without an end goes to the end of the text."""
    found, at = [], 0
    while begin := _PEM.search(text, at):
        end = _PEM_END.search(text, begin.end())
        at = end.end() if end else len(text)
        found.append((begin.start(), at))
    return found


def _operands(text: str, at: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Literals and names on the right-hand side: one operand, or quoted ones that are joined."""
    literals, names = [], []
    while at < len(text) and text[at] in " \t":
        at += 1
    while True:
        if (text.startswith(('"""', "'''"), at)) and (triple := _TRIPLE.match(text, at)):
            literals.append(triple.span(triple.lastindex))
            at = triple.end()
        elif quoted := _QUOTED.match(text, at):
            literals.append(quoted.span(quoted.lastindex))
            at = quoted.end()
        elif (name := _IDENTIFIER.match(text, at)) and (literals or names or _is_name(name[0])):
            names.append(name[0])
            at = name.end()
        elif not literals and not names and (bare := _BARE.match(text, at)):
            return [bare.span()], []
        else:
            return literals, names
        more = _PLUS.match(text, at)
        if "+" not in more[0] and "." not in more[0]:
            if not literals and names:
                # A word alone: a constant's name, or a bare literal of a configuration file.
                return [(at - len(names[-1]), at)], names
            return literals, names
        at = more.end()


def _is_name(word: str) -> bool:
    return word.isascii()


def pairs(text: str) -> list[tuple[str, int, list[tuple[int, int]], list[str]]]:
    """``(target name, position, literal spans, referenced names)`` of every assignment."""
    found = []
    for operator in _OPERATOR.finditer(text):
        start, end = operator.span()
        if text[end : end + 1] in ("=", ":") or (start and text[start - 1] in "=!<>:+-*/"):
            continue  # comparisons and scopes
        if operator[0] == ":" and text.startswith("//", end):
            continue  # an address
        if name := _target(text, start):
            block = None
            if operator[0] == ":":
                value = end
                while text[value : value + 1] in (" ", "\t"):
                    value += 1
                if text[value : value + 1] in ("|", ">"):
                    block = _block(text, start, value)
            literals, names = ([block], []) if block else _operands(text, end)
            if literals or names:
                found.append((name, start, literals, names))
    return found


def name_score(name: str) -> float:
    """How strongly a target name says that its value is secret, from 0 to 1."""
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    parts += [a + b for a, b in zip(parts, parts[1:], strict=False)]
    weight = sum(NAME_WEIGHTS.get(p, 0.0) for p in set(parts))
    return max(0.0, min(1.0, weight) - sum(NAME_PENALTIES.get(p, 0.0) for p in set(parts)))


def is_placeholder(value: str) -> bool:
    """Whether a literal stands for a value: a mark, or plain words that say so."""
    value = value.strip()
    if PLACEHOLDER.fullmatch(value):
        return True
    if not _PHRASE.fullmatch(value):
        return False
    # "changeme" and "your-token" are words; "MyS3cr3t" and "Test8fK2" have digits within.
    parts = {p.lower() for p in _NAME_PART.findall(value)}
    return bool(parts & PLACEHOLDER_WORDS)


def _has_phrase_name(name: str) -> bool:
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    return bool(PHRASE_NAMES & {*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))})


def literal_score(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a secret by itself, from -1 to 1.

    A value with spaces isn't one unless its name is one of phrases, or each of its lines is a
    piece without spaces.
    """
    spaced = any(re.search(r"[ \t]", line.strip()) for line in value.strip().splitlines())
    if len(value) < ASSIGN_LEAST or is_placeholder(value) or (spaced and not phrase):
        return -1.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(
        bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]")
    )
    return 0.2 * (n >= 12) + 0.15 * (kinds - 1) + 0.25 * (entropy >= 2.5) + 0.15 * (entropy >= 3.5)


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """``(start, end, name, score)`` of the literals that reach the threshold."""
    found = pairs(text)
    constants: dict[str, list[tuple[int, int]]] = {}
    refers: dict[str, set[str]] = {}
    for name, _, spans, names in found:
        constants.setdefault(name, []).extend(spans)
        refers.setdefault(name, set()).update(names)
    ranked = sorted(((name_score(name), name) for name in refers), reverse=True)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    seen: set[str] = set()
    # The name of the highest score that a literal flows into counts. Names are taken in that order, so
    # the first to reach a source is its best one, and what flows into the source was reached as well.
    for score, name in ranked:
        if not score:
            break
        for span in constants[name]:
            best.setdefault(span, (score, name))
        waiting = [] if name in seen else [name]
        seen.add(name)
        while waiting:
            source = waiting.pop()
            for span in constants[source] if source != name else ():
                if text[span[0] : span[1]] not in refers[source]:
                    best.setdefault(span, (score, name))
            for other in refers[source]:
                if other in refers and other not in seen:
                    seen.add(other)
                    waiting.append(other)
    result = []
    for (start, end), (score, name) in best.items():
        value = text[start:end]
        if value in refers:  # a constant's name, not its value
            continue
        total = score + literal_score(value, _has_phrase_name(name))
        if score >= 0.4 and total >= THRESHOLD:
            result.append((start, end, name, round(total, 3)))
    return sorted(result)


def spans(text: str | None) -> list[dict]:
    """All secrets of a text by start, then kind."""
    if not text:
        return []
    found = []
    assigns = "=" in text or ":" in text
    if assigns:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2), m[1], None))
    found += [(m.start(), 1, m.end(), m.start(), None, None) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), None, None) for m in HEX.finditer(text)]
    keys = sorted(private_keys(text)) if "-----BEGIN " in text else []
    if assigns or keys:
        base = sorted((f[0], f[2]) for f in found)
        at = reach = 0
        named = literals(text) if assigns else []
        if keys:
            starts, ends = [a for a, _ in keys], list(accumulate((b for _, b in keys), max))
            before = [bisect_left(starts, x[1]) for x in named]
            named = [x for x, k in zip(named, before, strict=True) if not k or ends[k - 1] <= x[0]]
        for start, end, name, score in sorted([*named, *((a, b, "private key", 2.0) for a, b in keys)]):
            while at < len(base) and base[at][0] <= start:
                reach = max(reach, base[at][1])
                at += 1
            if end > reach:
                found.append((start, 3, end, start, name, score))
    return [
        {"kind": KINDS[k], "start": s, "end": e, "value_start": v, "name": n, "score": p}
        for s, k, e, v, n, p in sorted(found, key=lambda f: f[:3])
    ]


def redact(text: str, found: list[dict], mark: str) -> str:
    """The text with every secret value replaced; overlapping values become one mark."""
    parts, at = [], 0
    for start, end in sorted((f["value_start"], f["end"]) for f in found):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPANS = (
    "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,name:string,score:double>>"
)
_SPANS = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("value_start", pa.int64()),
            ("name", pa.string()),
            ("score", pa.float64()),
        ]
    )
)


def _found(texts: pa.Array) -> pa.Array:
    return pa.array([spans(t.as_py()) for t in texts], _SPANS)


def _redacted(mark: str):
    def redacted(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            found = spans(text)
            out.append(redact(text, found, mark) if found else text)
        return pa.array(out, pa.string())

    return redacted


def find_secrets(docs: DataFrame, *, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` and an array of the secrets of its whole texts."""
    whole_texts(docs.sparkSession)
    return docs.withColumn(into, F.arrow_udf(_found, SPANS)(F.col(text)))


def listed(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, joined with commas."""
    some = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact_secrets(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secret values in its texts replaced by a mark; no row is dropped."""
    whole_texts(docs.sparkSession)
    return docs.withColumn(text, F.arrow_udf(_redacted(mark), "string")(F.col(text)))
