"""Licence recognition by sentences.

Sentences are normalised and looked up among known licence sentences; the identifiers
found, in text order, are matched against ordered licence rules.  An earlier rule takes
its sentences, so a notice is not also counted under a shorter rule.  A sentence that
only puts something under a licence ("... is licensed under the terms of ...", an SPDX
line) is known by the licence's name.  All of it happens inside the row, in the JVM:
nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from wardlight.llm import license_names

# Wording of public licence notices, in the order of their licences.
SENTENCES = {
    "mt0": "Released under the MIT License.",
    "mt1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mt2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mt3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "ap0": "Licensed under the Apache License, Version 2.0.",
    "ap1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "ap2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ap3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gp0": "This work is licensed under the GNU General Public License, version 3.",
    "gp1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gp2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gp3": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc0": "Licensed under CC BY-NC 4.0.",
    "cc1": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bs0": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bs1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bs2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bs3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
# Rules in the order in which they are tried: a licence and its sentences.
RULES = [
    ("MIT", ["mt1", "mt2", "mt3"]), ("MIT", ["mt1", "mt2"]), ("MIT", ["mt1"]), ("MIT", ["mt0"]),
    ("Apache-2.0", ["ap1", "ap2", "ap3"]), ("Apache-2.0", ["ap1", "ap3"]), ("Apache-2.0", ["ap1"]), ("Apache-2.0", ["ap0"]),
    ("GPL-3.0-or-later", ["gp1", "gp3"]), ("GPL-3.0-or-later", ["gp1"]), ("GPL-2.0-or-later", ["gp2", "gp3"]),
    ("GPL-2.0-or-later", ["gp2"]), ("GPL-3.0-only", ["gp0"]), ("CC-BY-NC-4.0", ["cc0"]), ("CC-BY-4.0", ["cc1"]),
    ("BSD-3-Clause", ["bs0", "bs1", "bs2", "bs3"]), ("BSD-2-Clause", ["bs0", "bs1", "bs2"]),
]
#: What the operator knows unless it is told otherwise; the SQL twin has the sentences and rules above only.
ALL_SENTENCES = SENTENCES | {
    k: s for k, s in license_names.SENTENCES.items() if re.sub(r"\W+", "", s) not in {re.sub(r"\W+", "", t) for t in SENTENCES.values()}
}
ALL_RULES = RULES + [(licence, ids) for licence, ids in license_names.RULES if ALL_SENTENCES.keys() >= set(ids)]
#: Every known sentence has one of these, so other texts need not be split.
MARK = "(?i)licen[cs]e|copyright|permission|warrant|redistribut"
#: The same for sentences that name a licence.
NAME_MARK = MARK + r"|public\s+domain|(?:released|distributed|published|available|provided|shared|offered|covered|governed)\s+(?:\S+\s+){0,2}(?:under|by|with)"
#: Before a name, in a normalised sentence.
LEAD = (
    "^(?!(.* )?(not|never|none|nothing|neither|if|unless|whether) )(([a-z0-9.]+ ){1,6}(is|are) )?(dual |also |hereby |made |currently )*"
    "(licensed|released|distributed|published|available|provided|shared|offered|covered|governed) (to you )?(under|by|with) "
    "((the |a |an )?(terms|conditions) (and conditions )?of )?(the |a |an )?|^([a-z]+ )?spdx license identifier |^license (is )?(the )?"
)
#: After a name.
TRAIL = (
    " (the license$|(please see|see|refer to|that can be found|which can be found|found in|as found|as described|in the license file"
    "|with ([a-z0-9.]+ )*(exception|note)).*$)"
)
#: A rule's sentences may have so many others between two of them (a list number, a name).
BETWEEN = 1


#: The text with its line ends as spaces; blank lines still end a sentence.
_RUNNING = r"replace(replace(regexp_replace(_text, '\n[ \t\r\n]*\n', char(1)), '\n', ' '), char(1), '\n')"


def normalised(sentence: str) -> str:
    """Small letters, digits and inner dots, single spaces."""
    return re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.]+", " ", sentence.lower()))


assert all(re.search(MARK, s) for s in SENTENCES.values())


def _name(words: str) -> str:
    """A normalised licence name; the word and point before a version do not count."""
    words = normalised(re.sub("([0-9])[+]", r"\1 or later", words)).replace("licence", "license")
    return re.sub("( version| v|v)[ .]*(?=[0-9])", " ", words)


def _map(pairs: dict[str, str]) -> str:
    """SQL for a constant map of strings without signs."""
    keys, values = ("split('" + "|".join(x) + "', '[|]')" for x in (pairs.keys(), pairs.values()))
    return f"map_from_arrays({keys}, {values})" if pairs else "map('', '')"


def _identifiers(text: str, sentences: dict[str, str], names: dict[str, str]) -> str:
    """SQL for the identifiers of a text's known sentences; | where too many others lie between.

    ``sentences`` and ``names`` have the identifiers of normalised sentences and names.
    """
    # These signs do not end a sentence.
    whole = rf"regexp_replace(regexp_replace({text}, '(?i)(spdx-license-identifier|licen[cs]e|free software):[ \t]+', '$1 '), '(?i)([ ,(]v)[.][ \t]+([0-9])', '$1$2')"
    # A sentence ends with a sign and a space, or with the line.
    parts = rf"split(regexp_replace({whole}, '([.!?:])[ \t]+', '$1\n'), '\n+')"
    later = "regexp_replace(lower(s), '([0-9])[+]', '$1 or later ')"
    clean = rf"replace(regexp_replace(regexp_replace({later}, '[^a-z0-9.]+', ' '), '^[ .]+|[ .]+$', ''), 'licence', 'license')"
    under = f"regexp_replace(regexp_replace(regexp_replace(c, '{LEAD}', '>'), '{TRAIL}', ''), '( version| v|v)[ .]*(?=[0-9])', ' ')"
    by_name = f"CASE WHEN c RLIKE '{LEAD}' THEN {_map(names)}[substr({under}, 2)] END"
    found = (
        f"filter(transform(transform({parts}, s -> {clean}), (c, i) -> struct(i, coalesce({_map(sentences)}[c], {by_name}) AS id)),"
        " x -> x.id IS NOT NULL)"
    )
    return (
        f"aggregate({found}, struct('' AS ids, -1 AS last), (a, x) -> struct("
        f"concat(a.ids, CASE WHEN a.ids <> '' AND x.i - a.last > {BETWEEN + 1} THEN '|' ELSE '' END, x.id) AS ids, x.i AS last),"
        f" a -> a.ids)"
    )


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code(i: int) -> str:
    """Codes of one length with a digit at the end, so that rules match whole codes only."""
    return "".join(chr(97 + i // d % 26) for d in (6760, 260, 10)) + str(i % 10)


def find_licenses(
    documents: DataFrame,
    sentences: dict[str, str] = ALL_SENTENCES,
    rules: list[tuple[str, list[str]]] = ALL_RULES,
    names: dict[str, list[str]] = license_names.NAMES,
) -> DataFrame:
    """``doc_id, licenses, n_notices`` for every row of ``documents``.

    ``licenses`` lists the licences found, each once, in alphabetical order and joined by
    commas (empty if none); ``n_notices`` counts the notices.  A text is read line by line
    and also as running text, so that wrapped sentences are found; the reading with more
    notices counts, line by line on a tie.  Null texts are empty; repeated rows give
    repeated results.

    ``sentences`` are known by a key; ``rules`` are tried in their order and have a licence
    and the keys of its sentences.  ``names`` has the names of each licence, for sentences
    that put something under it.
    """
    codes = {key: _code(i) for i, key in enumerate(sentences)}
    known = {normalised(re.sub(r"([ ,(]v)[.] ", r"\1", s)).replace("licence", "license"): codes[key] for key, s in sentences.items()}
    named = {licence: _code(len(codes) + i) for i, licence in enumerate(names)}
    called: dict[str, str] = {}
    for licence, all_names in names.items():
        for name in all_names:
            called.setdefault(_name(name), named[licence])
    # The first of rules with the same sentences counts.
    licences: dict[str, str] = {}
    for licence, ids in rules:
        licences.setdefault("".join(codes[k] for k in ids), licence)
    licences |= {code: licence for licence, code in named.items()}
    rule = "|".join(licences) or "-"
    table = "map({})".format(", ".join(f"'{ids}', {_literal(licence)}" for ids, licence in licences.items()) or "'', ''")
    lines, running = (f"regexp_extract_all({_identifiers(t, known, called)}, '({rule})', 1)" for t in ("_text", _RUNNING))
    text = F.col("text").cast("string")
    # Other sentences than the usual ones may have other words.
    usual = all(re.search(NAME_MARK, s, re.I) for s in sentences.values())
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.when(text.rlike(NAME_MARK), text) if usual else text).alias("_text")
    )
    read = texts.select("doc_id", F.expr(lines).alias("a"), F.expr(running).alias("b")).select(
        "doc_id", F.expr("coalesce(CASE WHEN size(b) > size(a) THEN b ELSE a END, array())").alias("notices")
    )
    return read.select(
        "doc_id", F.expr(f"array_join(array_sort(array_distinct(transform(notices, n -> {table}[n]))), ',')").alias("licenses"),
        F.size("notices").cast("long").alias("n_notices"),
    )


def _twin() -> str:
    known = ", ".join(f"('{normalised(s)}', '{name}')" for name, s in SENTENCES.items())
    rules = ", ".join(f"('{''.join(ids)}', '{licence}')" for licence, ids in RULES)
    rule = "|".join("".join(ids) for _, ids in RULES)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(ids, licence) AS (VALUES {rules}),
views AS (SELECT doc_id, 0 AS v, text FROM documents UNION ALL SELECT doc_id, 1,
    replace(replace(regexp_replace(text, '\n[ \t\r\n]*\n', chr(1), 'g'), chr(10), ' '), chr(1), chr(10)) FROM documents),
split AS (
    SELECT doc_id, v, string_split_regex(regexp_replace(text, '([.!?:])[ \t]+', '\1' || chr(10), 'g'), '\n+') AS s
    FROM views WHERE regexp_matches(text, '{MARK}')),
sentences AS (SELECT doc_id, v, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM split),
found AS (
    SELECT doc_id, v, i, id FROM sentences
    JOIN known ON sentence = regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')),
gaps AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, v ORDER BY i) AS gap FROM found),
joined AS (
    SELECT doc_id, v, string_agg(CASE WHEN gap > {BETWEEN + 1} THEN '|' ELSE '' END || id, '' ORDER BY i) AS ids
    FROM gaps GROUP BY doc_id, v),
notices AS (SELECT doc_id, v, regexp_extract_all(ids, '({rule})', 1) AS n FROM joined),
best AS (SELECT doc_id, n FROM notices QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(n) DESC, v) = 1),
named AS (SELECT doc_id, licence FROM (SELECT doc_id, unnest(n) AS ids FROM best) JOIN rules USING (ids))
SELECT d.doc_id, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licenses, count(licence) AS n_notices
FROM documents d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""


TWIN = _twin()
