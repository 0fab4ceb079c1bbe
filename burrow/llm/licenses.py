"""Licence scan by sentence rules.

A text becomes a stream of normalised words (lower case, whatever stands between words
is one space), so comment marks, line ends and capitals make no difference. Known
licence sentences, or the clauses of long ones, are found in the stream and give way to
their identifiers, longer ones first, so a sentence within a longer one isn't found
again. What is left is a sequence of identifiers, broken where more than ``GAP``
characters lie between two. A rule holds if its identifiers occur in its order within
one part of the sequence. A rule whose identifiers another rule that holds has too, and
more, gives way to it (BSD-2-Clause to BSD-3-Clause); a reservation of all rights counts
only where no licence is found. Only expressions of Spark run, and no shuffle.

Nulls: a null text is empty; an empty text has no sentence and no licence. Repeated
rows give repeated results. Columns other than the id and the text are ignored. Very
long texts are read whole; the time is linear in their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, in normalised form.
SENTENCES = {
    1: "all rights reserved",
    2: "released under the mit license",
    3: "licensed under the apache license version 2 0",
    4: "this work is licensed under the gnu general public license version 3",
    5: "licensed under cc by nc 4 0",
    6: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    7: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    8: "the software is provided as is without warranty of any kind express or implied",
    9: "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    10: "licensed under the apache license version 2 0 the license",
    11: "you may not use this file except in compliance with the license",
    12: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    13: "see the license for the specific language governing permissions and limitations under the license",
    14: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    15: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    16: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    17: "may be used to endorse or promote products derived from this software without specific prior written permission",
    18: "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    19: "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    20: "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    21: "you should have received a copy of the gnu general public license along with this program",
    22: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    23: "this source code form is subject to the terms of the mozilla public license v 2 0",
    24: "licensed under a creative commons attribution 4 0 international license",
    25: "licensed under a creative commons attribution sharealike 4 0 international license",
    26: "licensed under cc by 4 0",
    27: "licensed under cc by sa 4 0",
    28: "spdx license identifier mit",
    29: "spdx license identifier apache 2 0",
    30: "spdx license identifier gpl 3 0 or later",
    31: "spdx license identifier bsd 3 clause",
    32: "apache license version 2 0 january 2004",
    33: "terms and conditions for use reproduction and distribution",
    34: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    35: "provided that the above copyright notice and this permission notice appear in all copies",
    36: "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    37: "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    38: "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    39: "gnu general public license version 3 29 june 2007",
    40: "gnu general public license version 2 june 1991",
    41: "gnu lesser general public license version 3 29 june 2007",
    42: "gnu lesser general public license version 2 1 february 1999",
    43: "gnu affero general public license version 3 19 november 2007",
    44: "mozilla public license version 2 0 1 definitions",
    45: "eclipse public license v 2 0",
    46: "boost software license version 1 0 august 17th 2003",
    47: "this is free and unencumbered software released into the public domain",
    48: "do what the fuck you want to public license",
    49: "this software is provided as is without any express or implied warranty",
    50: "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    51: "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    52: "cc0 1 0 universal",
    53: "the artistic license 2 0",
    54: "licensed under a creative commons attribution noncommercial 4 0 international license",
    55: "licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    56: "licensed under a creative commons attribution noderivatives 4 0 international license",
    57: "spdx license identifier bsd 2 clause",
    58: "spdx license identifier gpl 2 0 only",
    59: "spdx license identifier gpl 2 0 or later",
    60: "spdx license identifier gpl 3 0 only",
    61: "spdx license identifier lgpl 2 1 or later",
    62: "spdx license identifier lgpl 3 0 or later",
    63: "spdx license identifier agpl 3 0 or later",
    64: "spdx license identifier mpl 2 0",
    65: "spdx license identifier isc",
    66: "spdx license identifier unlicense",
    67: "spdx license identifier cc0 1 0",
    68: "spdx license identifier epl 2 0",
    69: "spdx license identifier bsl 1 0",
    70: "spdx license identifier zlib",
    71: "released under the bsd license",
    72: "released under the apache license version 2 0",
    73: "licensed under the mit license",
}

#: Licence, and the identifiers that must occur in this order.
RULES = (
    ("MIT", (6, 7, 8)), ("MIT", (2,)), ("MIT", (28,)), ("MIT", (73,)),
    ("Apache-2.0", (10, 11, 12)), ("Apache-2.0", (11, 12, 13)), ("Apache-2.0", (32, 33)), ("Apache-2.0", (3,)), ("Apache-2.0", (29,)), ("Apache-2.0", (72,)),
    ("BSD-4-Clause", (14, 15, 16, 34, 17)), ("BSD-3-Clause", (14, 15, 16, 17)), ("BSD-2-Clause", (14, 15, 16)), ("BSD-3-Clause", (31,)), ("BSD-2-Clause", (57,)), ("BSD", (71,)),
    ("GPL-3.0-or-later", (18, 20)), ("GPL-3.0-or-later", (30,)), ("GPL-3.0", (39,)), ("GPL-3.0", (4,)), ("GPL-3.0", (60,)),
    ("GPL-2.0-or-later", (19, 20)), ("GPL-2.0-or-later", (59,)), ("GPL-2.0", (40,)), ("GPL-2.0", (58,)),
    ("LGPL-3.0-or-later", (36, 20)), ("LGPL-3.0-or-later", (62,)), ("LGPL-3.0", (41,)), ("LGPL-2.1-or-later", (37, 20)), ("LGPL-2.1-or-later", (61,)), ("LGPL-2.1", (42,)),
    ("AGPL-3.0-or-later", (38, 20)), ("AGPL-3.0-or-later", (63,)), ("AGPL-3.0", (43,)),
    ("ISC", (22, 35)), ("0BSD", (22,)), ("ISC", (65,)),
    ("MPL-2.0", (23,)), ("MPL-2.0", (44,)), ("MPL-2.0", (64,)), ("EPL-2.0", (45,)), ("EPL-2.0", (68,)), ("BSL-1.0", (46,)), ("BSL-1.0", (69,)),
    ("Unlicense", (47,)), ("Unlicense", (66,)), ("WTFPL", (48,)), ("Zlib", (49, 50, 51)), ("Zlib", (70,)), ("CC0-1.0", (52,)), ("CC0-1.0", (67,)), ("Artistic-2.0", (53,)),
    ("CC-BY-4.0", (24,)), ("CC-BY-4.0", (26,)), ("CC-BY-SA-4.0", (25,)), ("CC-BY-SA-4.0", (27,)), ("CC-BY-NC-4.0", (5,)), ("CC-BY-NC-4.0", (54,)), ("CC-BY-NC-SA-4.0", (55,)), ("CC-BY-ND-4.0", (56,)),
)
RESERVED, RESERVES = "all-rights-reserved", 1

#: Every known sentence holds one of these words, so a text without them has no identifier.
ANCHORS = ("licen[sc]e", "rights reserved", "copyright", "warrant", "redistribut", "permission", "free software", "liable", "public domain", "universal", "this software", "terms and conditions", "misrepresented")
_ANCHOR = "(?i)" + "|".join(a.replace(" ", "[^A-Za-z0-9]+") for a in ANCHORS)
#: Characters of the stream between two identifiers beyond which they don't belong together.
GAP = 600
_FIRST = 0xE000  # identifiers are characters for private use, which no normalised text has


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def _mark(k: int) -> str:
    return chr(_FIRST + k)


def _order(ids: tuple[int, ...]) -> str:
    """An expression on a sequence that holds if the ids occur in this order in one part."""
    return "[^|]*".join(map(_mark, ids))


def _within(ids: tuple[int, ...], more: tuple[int, ...]) -> bool:
    """Whether ids is a proper subsequence of more."""
    rest = iter(more)
    return len(ids) < len(more) and all(k in rest for k in ids)


def _longest_first() -> list[tuple[int, str]]:
    return sorted(SENTENCES.items(), key=lambda x: (-len(x[1]), x[0]))


def sequence(text: Column) -> Column:
    """The marks of the known sentences of a text in order, with ``|`` where a gap is; empty without an anchor."""
    words = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for k, said in _longest_first():
        out = F.replace(out, F.lit(f" {said} "), F.lit(f" {_mark(k)} "))
    parts = F.regexp_replace(F.regexp_replace(out, f"[a-z0-9 ]{{{GAP},}}", "|"), "[a-z0-9 ]+", "")
    return F.when(text.rlike(_ANCHOR), F.btrim(F.regexp_replace(parts, "[|]+", "|"), F.lit("|"))).otherwise("")


def licenses_of(marks: Column) -> Column:
    """The licences whose rule holds in a sequence, in the order of the rules."""
    holds = {n: marks.rlike(_order(ids)) for n, (_, ids) in enumerate(RULES)}
    each = []
    for n, (name, ids) in enumerate(RULES):
        own = holds[n]
        for m, (other, more) in enumerate(RULES):
            if other != name and _within(ids, more):
                own = own & ~holds[m]
        each.append(F.when(own, name))
    found = F.array_distinct(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return F.when((F.size(found) == 0) & F.contains(marks, F.lit(_mark(RESERVES))), F.array(F.lit(RESERVED))).otherwise(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (comma-joined; licences sorted by rule)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A generator between the steps: without one Catalyst would find the sequence again for each rule.
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(sequence(text))).alias("marks"))
    known = F.create_map(*(F.lit(x) for k in SENTENCES for x in (_mark(k), str(k))))
    ids = F.transform(F.split(F.replace("marks", F.lit("|"), F.lit("")), ""), lambda c: F.try_element_at(known, c))
    told = marked.select("doc_id", "marks", F.when(F.col("marks") == "", F.array().cast("array<string>")).otherwise(F.array_compact(ids)).alias("ids"))
    found = F.when(F.col("marks") == "", "").otherwise(F.array_join(licenses_of(F.col("marks")), ","))
    return told.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), found.alias("licenses"))


def sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    stream = r"' ' || regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g') || ' '"
    for k, said in _longest_first():
        stream = f"replace({stream}, ' {said} ', ' {_mark(k)} ')"
    rules = ", ".join(f"({n}, {quoted(name)}, {quoted(_order(ids))}, {quoted(','.join(map(str, ids)))})" for n, (name, ids) in enumerate(RULES))
    over = ", ".join(f"({n}, {m})" for n, (a, ids) in enumerate(RULES) for m, (b, more) in enumerate(RULES) if a != b and _within(ids, more))
    return rf"""
WITH rules(n, name, pattern, ids) AS (VALUES {rules}), over(n, m) AS (VALUES {over}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
streams AS (SELECT r, {stream} AS s FROM docs),
marks AS MATERIALIZED (SELECT r, trim(regexp_replace(regexp_replace(regexp_replace(s, '[a-z0-9 ]{{{GAP},}}', '|', 'g'), '[a-z0-9 ]+', '', 'g'), '[|]+', '|', 'g'), '|') AS marks FROM streams),
held AS MATERIALIZED (SELECT r, n, name FROM marks JOIN rules ON regexp_matches(marks, pattern) WHERE marks <> ''),
best AS (SELECT r, name, min(n) AS n FROM held h WHERE NOT EXISTS (SELECT 1 FROM over o JOIN held g ON g.n = o.m WHERE o.n = h.n AND g.r = h.r) GROUP BY r, name),
named AS (SELECT r, string_agg(name, ',' ORDER BY n) AS licenses FROM best GROUP BY r),
said AS (SELECT r, marks, list_transform(string_split(replace(marks, '|', ''), ''), lambda c: CAST(unicode(c) - {_FIRST} AS VARCHAR)) AS ids FROM marks WHERE marks <> '')
SELECT d.doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, CASE WHEN contains(marks, '{_mark(RESERVES)}') THEN '{RESERVED}' END, '') AS licenses
FROM docs d LEFT JOIN said USING (r) LEFT JOIN named USING (r)"""
