"""Licence scans by sentence-rule recognition, with DataFrame functions only.

Comment marks at line starts are left out. Then a text is cut into sentences twice: at sentence ends and line breaks (one-line notices), and at sentence ends and blank
lines with line breaks read as spaces (wrapped licence texts). A normalised sentence (lower case, runs of other marks
than letters and digits as one space) that is known maps to its identifier; others drop out. A known sentence with an
end inside is known by its parts, one after the other. A licence rule is an
ordered list of identifiers; it matches where they follow one another, with any sentences between. A rule that says
less than another one that matched is left out.

One row in, one row out, in one pass without a shuffle. Defined results: null and empty texts have no licences;
repeated rows are scanned like any others; very long texts are scanned whole; columns besides id and text play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    2: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    3: "Released under the MIT License",
    4: "Licensed under the MIT License",
    5: "SPDX-License-Identifier: MIT",
    10: "Licensed under the Apache License, Version 2.0",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    12: "you may not use this file except in compliance with the License",
    13: "You may obtain a copy of the License at",
    14: "See the License for the specific language governing permissions and limitations under the License",
    15: "SPDX-License-Identifier: Apache-2.0",
    20: "This work is licensed under the GNU General Public License, version 3",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    22: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    23: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    24: "See the GNU General Public License for more details",
    25: "This program is free software",
    26: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    27: "either version 2 of the License, or (at your option) any later version",
    28: "This work is licensed under the GNU General Public License, version 2",
    29: "SPDX-License-Identifier: GPL-3.0-or-later",
    30: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    31: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    32: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    33: "Licensed under the BSD 3-Clause License",
    34: "Licensed under the BSD 2-Clause License",
    40: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    41: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    42: "This is free and unencumbered software released into the public domain",
    43: "Licensed under the Mozilla Public License, version 2.0",
    44: "This work is licensed under the GNU Lesser General Public License, version 3",
    50: "Licensed under CC BY-NC 4.0",
    51: "Licensed under CC BY 4.0",
    52: "Licensed under CC BY-SA 4.0",
    53: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    54: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    55: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    56: "Licensed under CC0 1.0",
    60: "All rights reserved",
    61: "Unauthorized copying of this file, via any medium is strictly prohibited",
}
#: Rules in order: licence, identifiers in order, licences that say more.
RULES = [
    ("MIT", [1, 2], ()),
    ("MIT", [3], ()),
    ("MIT", [4], ()),
    ("MIT", [5], ()),
    ("Apache-2.0", [10], ()),
    ("Apache-2.0", [11, 12, 13, 14], ()),
    ("Apache-2.0", [15], ()),
    ("GPL-3.0", [20], ()),
    ("GPL-3.0", [21, 22, 23, 24], ()),
    ("GPL-3.0", [29], ()),
    ("GPL-2.0", [28], ()),
    ("GPL-2.0", [25, 26, 27, 22, 23, 24], ()),
    ("LGPL-3.0", [44], ()),
    ("BSD-3-Clause", [30, 31, 32], ()),
    ("BSD-3-Clause", [33], ()),
    ("BSD-2-Clause", [30, 31], ("BSD-3-Clause",)),
    ("BSD-2-Clause", [34], ()),
    ("ISC", [40], ()),
    ("MPL-2.0", [41], ()),
    ("MPL-2.0", [43], ()),
    ("Unlicense", [42], ()),
    ("CC-BY-NC-4.0", [50], ()),
    ("CC-BY-NC-4.0", [55], ()),
    ("CC-BY-4.0", [51], ()),
    ("CC-BY-4.0", [53], ()),
    ("CC-BY-SA-4.0", [52], ()),
    ("CC-BY-SA-4.0", [54], ()),
    ("CC0-1.0", [56], ()),
    ("Proprietary", [60, 61], ()),
    ("All-rights-reserved", [60], ("Proprietary",)),
]
BY_LINE = r"[.!?;]+(?:\s+|\z)|\n+"
BY_TEXT = r"[.!?;]+(?:\s+|\z)|\n\s*\n"
#: At line starts, as headers in source files have them.
COMMENT_MARKS = r"(?m)^[ \t]*(?:<!--|-->|--+|//+|/\*+|\*+/|[#*;%]+)"
OTHER_MARKS = r"[^\p{L}\p{N}]+"


def normalise(sentence: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def known() -> dict[str, list[int]]:
    """Normalised sentence -> identifiers, of whole sentences."""
    out: dict[str, list[int]] = {}
    for number, sentence in SENTENCES.items():
        out.setdefault(normalise(sentence), []).append(number)
    return out


def parts() -> dict[int, list[str]]:
    """Identifier -> the normalised parts of its sentence, cut as texts are."""
    return {number: [normalise(x) for x in re.split(r"[.!?;]+(?:\s+|\Z)", sentence) if normalise(x)] for number, sentence in SENTENCES.items()}


def _identifiers(text: Column, cut: str) -> Column:
    """Known identifiers of a text in order, each between commas."""
    cuts = parts()
    table: dict[str, str] = {}
    for number, names in cuts.items():
        for k, s in enumerate(names):
            table.setdefault(s, f",{number}," if len(names) == 1 else f",{number}.{k},")
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), cut), lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER_MARKS, " ")))
    ids = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    # an unknown sentence is a semicolon, so that parts with one between them aren't taken for a whole
    hits = F.transform(F.filter(sentences, lambda s: s != ""), lambda s: F.when(s.isin(list(table)), F.element_at(ids, s)).otherwise(F.lit(";")))
    found = F.concat_ws("", hits)
    for number, names in cuts.items():
        if len(names) > 1:
            found = F.replace(found, F.lit("".join(table[s] for s in names)), F.lit(f",{number},"))
    return F.regexp_replace(found, r";|,\d+\.\d+,", "")


def _matches(sequence: Column, rule: list[int]) -> Column:
    return sequence.like("%" + "%".join(f",{i}," for i in rule) + "%")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and wrapped_ids (identifiers by either cut), n_licences, and licences in the rules' order, by commas."""
    text = F.regexp_replace(F.col(text_col), COMMENT_MARKS, "")
    cut = docs.select(F.col(id_col).alias("doc_id"), _identifiers(text, BY_LINE).alias("sentence_ids"), _identifiers(text, BY_TEXT).alias("wrapped_ids"))
    names = list(dict.fromkeys(name for name, _, _ in RULES))

    def either(rule: list[int]) -> Column:
        return _matches(F.col("sentence_ids"), rule) | _matches(F.col("wrapped_ids"), rule)

    def has(name: str) -> Column:
        out = F.lit(False)
        for licence, rule, more in RULES:
            if licence == name:
                here = either(rule)
                for other in more:
                    here = here & ~has(other)
                out = out | here
        return out

    found = F.filter(F.array(*(F.when(has(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return cut.withColumn("n_licences", F.size(found).cast("long")).withColumn("licences", F.concat_ws(",", found))


def oracle() -> str:
    """The same scan as DuckDB SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    table = ", ".join(f"({quoted(s)}, {ids[0]})" for s, ids in known().items())
    m = "MAP {" + ", ".join(f"{quoted(s)}: {ids[0]}" for s, ids in known().items()) + "}"

    def identifiers(cut: str) -> str:
        plain = cut.replace("\\n", "\\n")
        cleaned = f"list_transform(string_split_regex(coalesce(text, ''), {quoted(plain)}), lambda s: trim(regexp_replace(lower(s), {quoted(OTHER_MARKS)}, ' ', 'g')))"
        return f"array_to_string(list_transform(list_filter({cleaned}, lambda s: list_contains(ks, s)), lambda s: ',' || (m[s])::VARCHAR || ','), '')"

    def either(rule: list[int]) -> str:
        pattern = quoted("%" + "%".join(f",{i}," for i in rule) + "%")
        return f"(sentence_ids LIKE {pattern} OR wrapped_ids LIKE {pattern})"

    def has(name: str) -> str:
        return "(" + " OR ".join("(" + " AND ".join([either(rule), *(f"NOT {has(o)}" for o in more)]) + ")" for licence, rule, more in RULES if licence == name) + ")"

    names = list(dict.fromkeys(name for name, _, _ in RULES))
    found = "list_filter([" + ", ".join(f"CASE WHEN {has(n)} THEN {quoted(n)} END" for n in names) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH k AS (SELECT list(s) AS ks FROM (VALUES {table}) AS v(s, i)),
cut AS (SELECT doc_id, {identifiers(BY_LINE)} AS sentence_ids, {identifiers(BY_TEXT)} AS wrapped_ids
        FROM (SELECT doc_id, text, ks, {m} AS m FROM documents, k))
SELECT doc_id, sentence_ids, wrapped_ids, len({found})::BIGINT AS n_licences, array_to_string({found}, ',') AS licences FROM cut"""
