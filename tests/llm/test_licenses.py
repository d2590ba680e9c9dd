"""Licence scans: full notices, order of rules, key words, edge cases."""

import re
import textwrap

import pytest

from tagloom.llm import licenses

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal.\n\n"
    "The above copyright notice and this permission notice shall be included in all copies.\n"
)
BSD = (
    "Redistribution and use in source and binary forms are permitted:\n"
    "1. Redistributions of source code must retain the above notice.\n"
    "2. Redistributions in binary form must reproduce the above notice.\n"
)
BSD_3 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice in the documentation.\n\n"
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.\n"
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
GPL = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation{2} either version {0} of the License, or (at "
    "your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY. See the GNU General Public License for more details.\n\n"
    "You should have received a copy of the GNU General Public License version {1} along with this program."
).replace(" version {1}", "")


def wrapped(text, mark=" * ", width=50):
    """A notice as it stands in a comment, its lines wrapped."""
    lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""]]
    return "\n".join((mark + line).rstrip() for line in lines)


CASES = [
    (None, []),
    ("", []),
    ("A plain text. The license of birds! Copyright law.", []),
    ("Text. Released under the MIT License.", ["MIT"]),
    (MIT, ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.\nx", ["GPL-3.0"]),
    (
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. It",
        ["GPL-3.0-or-later"],
    ),
    ("GNU General Public License v2. Or any later version. x", ["GPL-2.0-or-later"]),
    ("GNU Lesser General Public License", ["LGPL"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
    ("CC-BY-SA 4.0; CC BY 4.0", ["CC-BY-SA", "CC-BY"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD + "Neither the name of X nor Y may be used to endorse products.", ["BSD-3-Clause"]),
    ("The MIT License.\nSPDX-License-Identifier: Apache-2.0\n" + MIT, ["Apache-2.0", "MIT"]),
    ("© 2020 X. All rights reserved.", ["Proprietary"]),
    (wrapped(GPL.format("2", "2", ";")), ["GPL-2.0-or-later"]),
    (wrapped(GPL.format("3", "3", ",")), ["GPL-3.0-or-later"]),
    (wrapped(GPL.format("3", "3", ",").replace("GNU", "GNU Affero"), "# "), ["AGPL-3.0-or-later"]),
    (wrapped(GPL.format("2.1", "2.1", ";").replace("GNU", "GNU Lesser"), "// "), ["LGPL-2.1-or-later"]),
    (wrapped(BSD_3, ""), ["BSD-3-Clause"]),
    (wrapped(BSD_3, " * "), ["BSD-3-Clause"]),
    (wrapped(ISC), ["ISC"]),
    ("/*\n * Licensed under the Apache\n * License, Version 2.0 (the \"License\");\n */", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint main() {}", ["Apache-2.0", "MIT"]),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport x", ["GPL-2.0-or-later"]),
    ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note) OR BSD-3-Clause */", ["GPL-2.0-or-later", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: LGPL-3.0-only\r\nx", ["LGPL-3.0"]),
    ("MIT License\n\nCopyright (c) 2020 X", ["MIT"]),
    ("w " * 300_000 + "\nReleased under the MIT License.", ["MIT"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "mine") for i, (t, _) in enumerate(CASES)] * 2 + [(None, CASES[3][0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    return licenses.find_licenses(docs)


def test_licences(found):
    rows = found.collect()
    assert len(rows) == 2 * len(CASES) + 1
    for r in rows:
        assert r["licenses"] == CASES[3 if r["doc_id"] is None else r["doc_id"]][1], r["text"][:80]


def test_every_sentence_has_a_key_word():
    for name, pattern in licenses.SENTENCES:
        for way in re.sub(r"\([^()]*\)\??", "", pattern).split("|"):
            plain = way.replace("[cs]", "c").replace("?", "").replace("_", ".")
            assert re.search(licenses.KEY_WORDS, plain) or name == "spdx-mit", name


def test_long_sentences(spark):
    texts = ["gnu general public license v3 " * 30_000, "neither the name of x " * 40_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["licenses"] for r in licenses.find_licenses(docs).collect()]
    assert got == [["GPL-3.0"], []]


def test_rules_name_known_sentences():
    known = {name for name, _ in licenses.SENTENCES}
    used = {x for _, p in licenses.RULES for x in re.findall(r"[a-z][a-z0-9-]*", p)}
    assert used <= known


def test_scan_and_projection_only(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Aggregate", "Join"))
    assert found.limit(0).count() == 0
