"""Licences of texts by the sentences they hold.

Comment marks at line starts are taken off and wrapped lines are joined, so that a notice reads as it
was written. Each text is then cut into sentences: at blank lines, at full stops, before list items,
and at semicolons that don't go on with "either". An SPDX line is one sentence for every licence of its
expression. Each sentence is normalised, and a table of patterns maps it to the
identifier of a known licence sentence. What is left of a text is a short sequence of identifiers.
Ordered rules over that sequence name the licences; a rule uses up the sentences it matches, so that
the specific rules that come first take them from the general ones. A licence without a version is
named only where no version of it was found: notices mention it again ("see the ... for details").

All of it is one projection of built-in functions: a scan without a shuffle, whatever the size.
Patterns look for whole phrases within a sentence, and a sentence without any key word of the table
can't match: most sentences are passed over by one test.

Defined results: NULL and empty texts have no sentences and no licence. Equal licences are listed
once, in the order of the rules. Rows are independent, also repeated ones. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What may stand between two parts of one licence sentence: a number of words.
WITHIN = "([^ ]+ ){0,30}"
LATER = " ([^ ]+ ){0,30}any later version "
# Sentence patterns by identifier, tried in this order on normalised sentences with a space at
# either end. Numbers keep their full stop, written "_".
SENTENCES = (
    ("spdx-mit", " spdx license identifier mit "),
    ("spdx-apache-2", " spdx license identifier apache 2_0 "),
    ("spdx-isc", " spdx license identifier isc "),
    ("spdx-agpl-3-later", " spdx license identifier agpl 3_0(\\+| or later) "),
    ("spdx-agpl-3", " spdx license identifier agpl 3_0 (only )?"),
    ("spdx-lgpl-3-later", " spdx license identifier lgpl 3_0(\\+| or later) "),
    ("spdx-lgpl-3", " spdx license identifier lgpl 3_0 (only )?"),
    ("spdx-lgpl-21-later", " spdx license identifier lgpl 2_1(\\+| or later) "),
    ("spdx-lgpl-21", " spdx license identifier lgpl 2_1 (only )?"),
    ("spdx-gpl-3-later", " spdx license identifier gpl 3_0(\\+| or later) "),
    ("spdx-gpl-3", " spdx license identifier gpl 3_0 (only )?"),
    ("spdx-gpl-2-later", " spdx license identifier gpl 2_0(\\+| or later) "),
    ("spdx-gpl-2", " spdx license identifier gpl 2_0 (only )?"),
    ("spdx-bsd-3", " spdx license identifier bsd 3 clause "),
    ("spdx-bsd-2", " spdx license identifier bsd 2 clause "),
    ("spdx-mpl-2", " spdx license identifier mpl 2_0 "),
    ("agpl-3-later", f" gnu affero general public licen[cs]e {WITHIN}v(ersion)? ?3(_0)?{LATER}"),
    ("agpl-3", f" gnu affero general public licen[cs]e {WITHIN}v(ersion)? ?3"),
    ("agpl-named", " gnu affero general public licen[cs]e "),
    ("lgpl-3-later", f" gnu (lesser|library) general public licen[cs]e {WITHIN}v(ersion)? ?3(_0)?{LATER}"),
    ("lgpl-21-later", f" gnu (lesser|library) general public licen[cs]e {WITHIN}v(ersion)? ?2_1{LATER}"),
    ("lgpl-3", f" gnu (lesser|library) general public licen[cs]e {WITHIN}v(ersion)? ?3"),
    ("lgpl-21", f" gnu (lesser|library) general public licen[cs]e {WITHIN}v(ersion)? ?2_1"),
    ("lgpl", " gnu (lesser|library) general public licen[cs]e "),
    ("gpl-3-later", f" gnu general public licen[cs]e {WITHIN}v(ersion)? ?3(_0)?{LATER}"),
    ("gpl-2-later", f" gnu general public licen[cs]e {WITHIN}v(ersion)? ?2(_0)?{LATER}"),
    ("gpl-3", f" gnu general public licen[cs]e {WITHIN}v(ersion)? ?3"),
    ("gpl-2", f" gnu general public licen[cs]e {WITHIN}v(ersion)? ?2"),
    ("gpl-named", " gnu general public licen[cs]e | licen[cs]ed under the gpl "),
    ("version-3-later", f" version 3 of the licen[cs]e{LATER}"),
    ("version-2-later", f" version 2 of the licen[cs]e{LATER}"),
    ("version-3", " version 3 of the licen[cs]e "),
    ("version-2", " version 2 of the licen[cs]e "),
    ("or-later", " or (at your option )?any later version "),
    ("apache-2", " apache licen[cs]e (version )?v?2_0 "),
    ("apache-named", " apache (software )?licen[cs]e "),
    ("mit-named", " mit licen[cs]e | licen[cs]ed under (the )?mit "),
    ("mit-grant", " permission is hereby granted free of charge to any person obtaining a copy "),
    ("mit-condition", " copyright notice and this permission notice shall be included "),
    ("isc-grant", " permission to use copy modify and or distribute this software for any purpose "),
    ("bsd-grant", " redistribution and use in source and binary forms "),
    ("bsd-source", " redistributions of source code must retain "),
    ("bsd-binary", " redistributions in binary form must reproduce "),
    ("bsd-endorse", " neither the names? of ([^ ]+ ){1,60}may be used to endorse "),
    ("bsd-named", " bsd licen[cs]e | bsd [234] clause | [234] clause bsd "),
    ("mpl-2", " mozilla public licen[cs]e (v|version )?2_0 "),
    ("unlicense", " free and unencumbered software released into the public domain "),
    ("cc0", " cc0 | creative commons zero "),
    ("cc-by-nc-nd", " cc by nc nd | attribution noncommercial noderivatives "),
    ("cc-by-nc-sa", " cc by nc sa | attribution noncommercial sharealike "),
    ("cc-by-nc", " cc by nc | attribution non ?commercial "),
    ("cc-by-nd", " cc by nd | attribution noderivatives "),
    ("cc-by-sa", " cc by sa | attribution sharealike "),
    ("cc-by", " cc by | creative commons attribution "),
    ("no-warranty", " provided as is without warranty | without any warranty | express or implied warrant"),
    ("all-rights", " all rights reserved "),
    ("copyright", " copyright (c |© ?)?[12][0-9][0-9][0-9] "),
)
# Every sentence above holds one of these in lower case, before it is normalised.
KEY_WORDS = (
    "licen[cs]|permission|redistribut|neither|later|domain|cc0|cc[^a-z]+by|creative|attribution"
    "|warrant|reserved|copyright|bsd"
)
# Ordered rules: a licence and the sequence of identifiers that shows it, as a pattern over the
# sequence, in which every identifier stands between marks of its own: ";a;;b;".
RULES = (
    ("AGPL-3.0-or-later", ";agpl-3-later;|;spdx-agpl-3-later;|;agpl-3;;or-later;|;agpl-named;;version-3-later;"),
    ("AGPL-3.0", ";agpl-3;|;spdx-agpl-3;|;agpl-named;;version-3;"),
    ("AGPL", ";agpl-named;"),
    ("LGPL-3.0-or-later", ";lgpl-3-later;|;spdx-lgpl-3-later;|;lgpl-3;;or-later;|;lgpl;;version-3-later;"),
    ("LGPL-2.1-or-later", ";lgpl-21-later;|;spdx-lgpl-21-later;|;lgpl-21;;or-later;"),
    ("LGPL-3.0", ";lgpl-3;|;spdx-lgpl-3;|;lgpl;;version-3;"),
    ("LGPL-2.1", ";lgpl-21;|;spdx-lgpl-21;"),
    ("LGPL", ";lgpl;"),
    ("GPL-3.0-or-later", ";gpl-3-later;|;spdx-gpl-3-later;|;gpl-3;;or-later;|;gpl-named;;version-3-later;"),
    ("GPL-2.0-or-later", ";gpl-2-later;|;spdx-gpl-2-later;|;gpl-2;;or-later;|;gpl-named;;version-2-later;"),
    ("GPL-3.0", ";gpl-3;|;spdx-gpl-3;|;gpl-named;;version-3;"),
    ("GPL-2.0", ";gpl-2;|;spdx-gpl-2;|;gpl-named;;version-2;"),
    ("GPL", ";gpl-named;"),
    ("Apache-2.0", ";apache-2;|;spdx-apache-2;"),
    ("Apache", ";apache-named;"),
    ("BSD-3-Clause", ";bsd-grant;.*;bsd-source;.*;bsd-binary;.*;bsd-endorse;|;spdx-bsd-3;"),
    ("BSD-2-Clause", ";bsd-grant;.*;bsd-source;.*;bsd-binary;|;spdx-bsd-2;"),
    ("BSD", ";bsd-named;"),
    ("MIT", ";mit-grant;.*;mit-condition;|;mit-grant;|;mit-named;|;spdx-mit;"),
    ("ISC", ";isc-grant;|;spdx-isc;"),
    ("MPL-2.0", ";mpl-2;|;spdx-mpl-2;"),
    ("Unlicense", ";unlicense;"),
    ("CC0-1.0", ";cc0;"),
    ("CC-BY-NC-ND", ";cc-by-nc-nd;"),
    ("CC-BY-NC-SA", ";cc-by-nc-sa;"),
    ("CC-BY-NC", ";cc-by-nc;"),
    ("CC-BY-ND", ";cc-by-nd;"),
    ("CC-BY-SA", ";cc-by-sa;"),
    ("CC-BY", ";cc-by;"),
    ("Proprietary", ";all-rights;"),
)
# Rules that say nothing where a name that begins so was found: what is named without a version.
GENERAL = {"AGPL": "AGPL-", "LGPL": "LGPL-", "GPL": "GPL-", "Apache": "Apache-", "BSD": "BSD-"}
# Steps that make a text one line a paragraph, as (pattern, replacement): comment marks off, SPDX
# lines and list items apart, and a semicolon before "either" no end.
STEPS = (
    (r"\n[ \t]*(//+|/?\*+/?|#+|--+|;+|%+|dnl )?[ \t\r]*", "\n"),
    (r"([Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier:[^\n]*)", "\n\n{1}\n\n"),
    (r"\n([-*•]|[(]?[0-9a-z][.)])[ \t]+", "\n\n"),
    (r";([ \t\r\n]+either[ \t\r\n])", ",{1}"),
)
# A sentence ends at a blank line, a colon before a line end, or a mark before white space.
SENTENCE_END = r"\n\n+|:[ \t\r]*\n|[.;!?][ \t\r\n]"
SPDX = r"[Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier:"
SPDX_PARTS = r"[ \t]+(OR|AND|WITH)[ \t]+|[()]+"
IN_NUMBER = "([0-9])[.]([0-9])"
NOT_WORD = r"[^\p{L}\p{N}_+©]+"


def normalised(sentence: Column) -> Column:
    """Lower case, words between single spaces, no marks but those within numbers."""
    numbers = F.regexp_replace(F.lower(sentence), IN_NUMBER, "$1_$2")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(numbers, NOT_WORD, " ")), F.lit(" "))


def sentences_of(text: Column) -> Column:
    """The sentences of a text that hold a key word; one a licence for an SPDX line."""
    plain = F.concat(F.lit("\n"), text)
    for pattern, new in STEPS:
        plain = F.regexp_replace(plain, pattern, new.replace("{1}", "$1"))
    known = F.filter(F.split(plain, SENTENCE_END), lambda s: F.lower(s).rlike(KEY_WORDS))
    one_each = lambda s: F.when(
        s.rlike(SPDX),
        F.transform(
            F.split(F.regexp_replace(s, SPDX, ""), SPDX_PARTS),
            lambda part: F.concat(F.lit("SPDX-License-Identifier "), part),
        ),
    ).otherwise(F.array(s))
    return F.flatten(F.transform(known, one_each))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence; NULL for others."""
    name, pattern = SENTENCES[0]
    found = F.when(sentence.rlike(pattern), F.lit(name))
    for name, pattern in SENTENCES[1:]:
        found = found.when(sentence.rlike(pattern), F.lit(name))
    return found


def _apply_rules(ids: Column) -> Column:
    """The licences that the rules see in a sequence, one rule after the other."""
    chain = F.array_join(F.transform(ids, lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(pattern).alias("pattern"),
                F.lit(GENERAL.get(name)).cast("string").alias("versions"),
            )
            for name, pattern in RULES
        ]
    )
    start = F.struct(chain.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        rules,
        start,
        lambda acc, rule: F.when(
            F.rlike(acc["rest"], rule["pattern"]),
            F.struct(
                F.regexp_replace(acc["rest"], rule["pattern"], F.lit("")).alias("rest"),
                F.when(
                    F.exists(acc["found"], lambda name: name.startswith(rule["versions"])), acc["found"]
                )
                .otherwise(F.array_append(acc["found"], rule["name"]))
                .alias("found"),
            ),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )


def find_licenses(
    docs: DataFrame, *, text: str = "text", sequence: str = "sentence_ids", into: str = "licenses"
) -> DataFrame:
    """``docs``, the identifiers of their licence sentences in order, and the licences found.

    Columns of ``docs`` that are named like the two new ones are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    key = lambda s: F.lower(s).rlike(KEY_WORDS)
    # Most texts hold no key word at all; only the others are cut into sentences.
    ids = F.array_compact(F.transform(F.transform(sentences_of(whole), normalised), identifier))
    named = docs.withColumn(sequence, F.when(key(whole), ids).otherwise(none))
    found = F.when(F.size(sequence) > 0, _apply_rules(F.col(sequence))).otherwise(none)
    return named.withColumn(into, found)
