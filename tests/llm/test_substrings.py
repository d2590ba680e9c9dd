"""Substring dedup: brute force over all units, planted passages, offsets, edge cases."""

import random
import re

import pytest

from tagloom.llm import substrings


def sentence(rnd, n):
    words = ["".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(2, 6))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus():
    rnd = random.Random(4)
    passages = [" ".join(sentence(rnd, rnd.randint(1, 25)) for _ in range(6)) for _ in range(5)]
    boiler = "all rights are reserved by the owner of this page, no copies."
    rows = []
    for i in range(200):
        lines = [" ".join(sentence(rnd, rnd.randint(1, 15)) for _ in range(4)) for _ in range(5)]
        if i % 3 == 0:
            lines.insert(2, boiler.upper() if i % 2 else boiler)
        if i % 10 == 0:  # into the middle of a line
            words = lines[1].split()
            words[7:7] = passages[i // 10 % 5].split()
            lines[1] = " ".join(words)
        rows.append((i, "\n".join(lines)))
    rows += [(300, "The a.\nThe a.\nThe a."), (301, "x " * 50_000 + "end.\n" + passages[0])]
    return rows + [(302, None), (303, ""), (304, " \n .. \n")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_runs_are_found_where_passages_came_before(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.repeated_passages(docs).collect()
    caught = {r["id"] for r in got}
    assert set(range(50, 200, 10)) <= caught  # a passage that came before
    assert not caught & {i for i in range(200) if i % 3 and i % 10}  # nothing of theirs repeats


def test_removed_text_keeps_offsets(spark, rows):
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, start long")
    texts = dict(rows)
    for r in substrings.remove_repeats(docs).collect():
        assert r["start"] == r["doc_id"]
        text = texts[r["doc_id"]]
        gone = sum(s["end"] - s["start"] for s in r["removed"])
        assert (r["text"] is None) if text is None else len(r["text"]) == len(text) - gone
        for s in r["removed"]:
            piece = text[s["start"] : s["end"]]
            assert piece == piece.strip() and re.search(r"\w", piece)


def test_null_and_repeated_rows(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(1, line), (1, line), (None, line), (None, line), (1, line + "\n" + line), (0, "x\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["id"]), r["start"], r["end"]) for r in substrings.repeated_passages(docs).collect())
    n = len(line)
    assert got == [("1", 0, n), ("1", 0, 2 * n + 1), ("None", 0, n)]


def test_columns_named_like_ours(spark):
    line = "one two three four five six seven eight nine ten eleven"
    names = ["id", "mark", "row", "removed", "cut__spans", "cut__id", "cut__mark", "a", "words", "start"]
    rows = [(i, line, *names) for i in (1, 2)]
    types = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    got = substrings.remove_repeats(spark.createDataFrame(rows, types)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [line, ""]
    for r in got:
        assert all(r[n] == n for n in names if n != "removed")
        assert len(r) == len(names) + 2
    assert [(s["start"], s["end"]) for s in got[1]["removed"]] == [(0, len(line))]


def test_filter_changes_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame([r for r in rows if r[0] < 100], "doc_id long, text string")
    whole = sorted(map(tuple, substrings.repeated_passages(docs).collect()))
    monkeypatch.setattr(substrings, "FILTER_BITS", 7)  # all bits set: every window is written
    assert sorted(map(tuple, substrings.repeated_passages(docs).collect())) == whole


def test_cuts_equal_patterns():
    end = re.compile(r"\n+|(?<=[.!?])[^\S\n]+|(?<=[a-zé])[^\S\n]+(?=[A-ZÜ])")
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("ab Éü.A\t\n!_Ü é9") for _ in range(rnd.randint(1, 80)))
        at, plain = 0, []
        for m in [*re.finditer(end, text), None]:
            stop = m.start() if m else len(text)
            plain += [(at, stop)] if re.search(r"\w", text[at:stop]) else []
            at = m.end() if m else at
        if not re.search("[üÉ]", text):  # classes of the pattern above hold é and Ü only
            assert [u[:2] for u in substrings.units(text)] == plain
        words = [u[3] - u[2] for u in substrings.units(text)]
        assert sum(words) == len(re.findall(r"\w+", text))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.repeated_passages(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 0


def test_units_that_were_never_together_stay(spark):
    names = ["Gestern sagte", "Der Minister", "Die Regierung", "Am Montag", "Kanzler Meier", "In Berlin"]
    rows = [(i, f"{name}\nx{i} y{i}") for i, name in enumerate(names)]
    rows += [(10, "\n".join(names)), (11, "\n".join(reversed(names)))]
    assert substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    again = [*rows, (12, "Neu hier\n" + "\n".join(names))]
    got = substrings.repeated_passages(spark.createDataFrame(again, "doc_id long, text string")).collect()
    assert [(r["id"], r["start"], r["units"], r["words"]) for r in got] == [(12, 9, 11, 12)]


def test_only_capitals_cut():
    assert len(substrings.units("слово другое слово третье")) == 1
    assert len(substrings.units("слово Другое слово Третье")) == 3
    assert len(substrings.units("한국어 문장 하나 입니다")) == 1
    assert len(substrings.units("λέξη άλλη λέξη")) == 1


def sequences(rows, least):
    """Runs to remove: units within a sequence of at least that many words that came before."""
    seen, out = set(), set()
    for id, text in sorted(rows):
        found, gone = substrings.units(text), set()
        for i in range(len(found)):
            for j in range(i + 1, len(found) + 1):
                if found[j - 1][3] - found[i][2] >= least:
                    words = " ".join(re.findall(r"\w+", text[found[i][0] : found[j - 1][1]].lower()))
                    gone.update(range(i, j) if words in seen else ())
                    seen.add(words)
        for i in sorted(gone - {k + 1 for k in gone}):
            j = next(k for k in range(i, len(found) + 1) if k not in gone)
            out.add((id, found[i][0], found[j - 1][1], j - i, found[j - 1][3] - found[i][2]))
    return out


def test_passages_match_brute_force(spark, rows):
    some = [r for r in rows if r[0] != 301]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    got = substrings.repeated_passages(docs).collect()
    assert {tuple(r[c] for c in ("id", "start", "end", "units", "words")) for r in got} == sequences(
        [(i, t or "") for i, t in some], substrings.LEAST_WORDS
    )


def test_passage_without_marks_in_the_middle_of_a_line(spark):
    rnd = random.Random(9)
    words = lambda n: ["".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(3, 7))) for _ in range(n)]
    for n in (50, 60, 200):
        passage = words(n)
        ways = [" ".join(passage), ", ".join(passage), " ".join(passage).upper(), " ".join(passage).title()]
        rows = []
        for i, way in enumerate(ways * 3):
            rows.append((i, " ".join(words(rnd.randint(1, 30))) + " " + way + " " + " ".join(words(20))))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["id"]: r for r in substrings.repeated_passages(docs).collect()}
        assert set(got) == set(range(1, len(rows)))
        for i, r in got.items():
            text, start = rows[i][1], rows[i][1].index(ways[i % 4])
            assert start <= r["start"] < r["end"] <= start + len(ways[i % 4])
            assert r["words"] >= n - 2 * substrings.NEAR
