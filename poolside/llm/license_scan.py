"""Licence scans by sentence rules (op6), in DataFrame functions only.

1. A text is cut into segments (after ``.``, ``!`` or ``?`` and white space, after ``:`` at a line's end, and at
   blank lines, those of comment marks alone too), and these into lines. Lines are normalised: A-Z in lower case,
   runs of anything but a-z and 0-9 one space, so that comment marks go.
2. What licences are known by is mapped to identifiers, the rest is left out: the longest known sentence that the
   last lines of a segment make up (a wrapped one), and known lines before it (titles), in order.
3. The identifiers, in order, are matched against ordered rules: a rule is a licence and the identifiers that
   must follow each other. Longer rules come first, and what a rule has matched is taken out.

One pass without a shuffle, as the tables of sentences and rules are short and fixed. Null and empty texts
have no sentences and no licence (an empty list). Ids are passed on as they are, so rows whose id is null or
repeats stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a sentence that goes on over line ends is over. Blank lines may hold comment marks.
SEGMENT_END = r"[.!?][ \t\n]+|:[ \t]*\n|\n[ \t*#/;%-]*\n"

# Sentences of the licences' published texts and of the notices that name them.
SENTENCES = {
    "mit-name": "MIT License",
    "mit-the-name": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "apache-name": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-short": "Licensed under the GNU General Public License, version 3.",
    "gpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3-later-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-spdx": "SPDX-License-Identifier: MPL-2.0",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
}
# Licences and the sentences that must follow each other, in the order of matching.
RULES = [
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("Apache-2.0", "apache-header apache-copy apache-basis"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("GPL-3.0-or-later", "gpl3-header gpl-hope"),
    ("GPL-2.0-or-later", "gpl2-header gpl-hope"),
    ("MIT", "mit-grant mit-notice"),
    ("Apache-2.0", "apache-name apache-version"),
    ("MIT", "mit-released"),
    ("MIT", "mit-licensed"),
    ("MIT", "mit-spdx"),
    ("MIT", "mit-the-name"),
    ("MIT", "mit-name"),
    ("ISC", "isc-grant"),
    ("ISC", "isc-spdx"),
    ("BSD-2-Clause", "bsd2-spdx"),
    ("BSD-3-Clause", "bsd3-spdx"),
    ("Apache-2.0", "apache-header"),
    ("Apache-2.0", "apache-licensed"),
    ("Apache-2.0", "apache-spdx"),
    ("GPL-3.0-only", "gpl3-licensed"),
    ("GPL-3.0-only", "gpl3-short"),
    ("GPL-3.0-only", "gpl3-spdx"),
    ("GPL-3.0-or-later", "gpl3-header"),
    ("GPL-3.0-or-later", "gpl3-later-spdx"),
    ("GPL-2.0-or-later", "gpl2-header"),
    ("MPL-2.0", "mpl2-subject"),
    ("MPL-2.0", "mpl2-spdx"),
    ("CC-BY-4.0", "cc-by-licensed"),
    ("CC-BY-4.0", "cc-by-work"),
    ("CC-BY-SA-4.0", "cc-by-sa-licensed"),
    ("CC-BY-NC-4.0", "cc-by-nc-licensed"),
    ("CC-BY-NC-4.0", "cc-by-nc-work"),
    ("Unlicense", "unlicense-public"),
]

#: Takes the place of matched identifiers, so what stood around them doesn't meet.
TAKEN = " | "


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {normal(s): name for name, s in SENTENCES.items()}


def rule_keys() -> list[tuple[str, str]]:
    """Licence, and its identifiers as they stand in a line of identifiers, each with a space of its own on both sides."""
    return [(name, " " + "  ".join(ids.split()) + " ") for name, ids in RULES]


def lines(text: Column) -> Column:
    """The normalised lines of a text in lower case, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def segment_ids(known: Column, parts: Column) -> Column:
    """The identifiers in a segment's lines, with nulls for other lines."""
    longest = max(len(s.split()) for s in known_sentences())  # a line has a word at least
    last = lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), " ")
    sizes = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.least(F.size(parts), F.lit(longest)))).otherwise(F.array().cast("array<int>"))
    wrapped = F.coalesce(F.array_max(F.filter(sizes, lambda k: F.try_element_at(known, last(k)).isNotNull())), F.lit(0))
    # a list of one, so that it is found once
    return F.flatten(
        F.transform(
            F.array(wrapped),
            lambda n: F.concat(F.transform(F.slice(parts, F.lit(1), F.size(parts) - n), lambda s: F.try_element_at(known, s)), F.when(n > 0, F.array(F.try_element_at(known, last(n)))).otherwise(F.array().cast("array<string>"))),
        )
    )


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_sentences (parts between sentence and line ends), sentence_ids (those known, in order) and licences (matched, in the rules' order)."""
    known = F.create_map(*(F.lit(x) for pair in known_sentences().items() for x in pair))
    low = F.replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit("\r\n"), F.lit("\n"))
    low = F.translate(low, "\r", "\n")
    segments = F.transform(F.split(low, SEGMENT_END), lambda s: lines(s))
    at = df.select(F.col(id_col), segments.alias("_s"))
    at = at.select(id_col, F.aggregate("_s", F.lit(0).cast("long"), lambda n, s: n + F.size(s)).alias("n_sentences"), F.filter(F.flatten(F.transform("_s", lambda s: segment_ids(known, s))), lambda i: i.isNotNull()).alias("sentence_ids"))
    rules = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(key).alias("ids")) for name, key in rule_keys()))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    found = F.aggregate(
        rules,
        F.struct(line.alias("line"), F.array().cast("array<string>").alias("found")),
        lambda a, r: F.struct(
            F.replace(a["line"], r["ids"], F.lit(TAKEN)).alias("line"),
            F.when(F.contains(a["line"], r["ids"]), F.array_append(a["found"], r["licence"])).otherwise(a["found"]).alias("found"),
        ),
        lambda a: F.array_distinct(a["found"]),
    )
    return at.withColumn("licences", F.when(F.size("sentence_ids") > 0, found).otherwise(F.array().cast("array<string>")))


def scan_sql() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in known_sentences().items())
    steps, last = [], "r0"
    for k, (name, key) in enumerate(rule_keys(), 1):
        steps.append(
            f"r{k} AS (SELECT doc_id, n_sentences, sentence_ids, replace(line, {quoted(key)}, {quoted(TAKEN)}) AS line, CASE WHEN contains(line, {quoted(key)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM {last})"
        )
        last = f"r{k}"
    # list_distinct keeps no order, so a licence counts where it stands first
    licences = "list_filter(found, lambda x, i: list_position(found, x) = i)"
    return f"""WITH known AS (SELECT MAP(list(s), list(i)) AS m FROM (VALUES {known}) AS v(s, i)),
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.!?][ \t\r\n]+|[\r\n]+'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS parts FROM documents),
r0 AS (SELECT doc_id, n_sentences, sentence_ids, ' ' || array_to_string(sentence_ids, '  ') || ' ' AS line, []::VARCHAR[] AS found
FROM (SELECT doc_id, len(parts) AS n_sentences, list_filter(list_transform(parts, lambda s: m[s]), lambda i: i IS NOT NULL) AS sentence_ids FROM cut, known)),
{", ".join(steps)}
SELECT doc_id, n_sentences, array_to_string(sentence_ids, ' ') AS sentence_ids, array_to_string({licences}, ' ') AS licences FROM {last}"""


def scan_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_sentences, and sentence_ids and licences as text."""
    return scan_licences(df, id_col, text_col).select(id_col, "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))
