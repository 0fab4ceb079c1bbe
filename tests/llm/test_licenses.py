"""The licence scan over published texts, as they are wrapped and spelt."""

import re

import pytest

from burrow.llm import licenses
from tests.llm.odd import no_documents, odd_documents
from tests.llm.test_lines_and_mixing import oracle, rows_of, same

# Public licence texts and notices.
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD2 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
BSD3 = BSD2.replace("\n\nTHIS SOFTWARE", """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("software: you", "software; you").replace("version 3", "version 2")
LGPL = GPL2.replace("General Public", "Lesser General Public").replace("version 2", "version 2.1").replace("program", "library")
ISC = """Copyright (c) 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2,
    "LGPL-2.1-or-later": LGPL, "ISC": ISC, "MPL-2.0": MPL,
}


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def scanned(spark, texts):
    return [r.licenses for r in sorted(licenses.license_scan(documents(spark, texts)).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("form", ["plain", "hash", "slashes", "stars", "one line", "capitals"])
def test_published_texts_give_one_licence(spark, form):
    shape = {
        "plain": lambda t: f"Some code before.\n\n{t}\n\nAnd more after.", "hash": lambda t: re.sub("(?m)^", "# ", t), "slashes": lambda t: re.sub("(?m)^", "// ", t),
        "stars": lambda t: "/*\n" + re.sub("(?m)^", " * ", t) + "\n */", "one line": lambda t: " ".join(t.split()), "capitals": str.upper,
    }[form]
    assert scanned(spark, [shape(t) for t in TEXTS.values()]) == list(TEXTS)


def test_order_gaps_and_several_licences(spark):
    prose = "Many other words stand here and there. " * 40
    clauses = MIT.split("\n\n")
    texts = [
        "Text.\nLicensed under the Apache License, Version 2.0.\nMore. All rights reserved.", None, "the licence of poets is not known here", "Text that wraps. Licensed under\ncc BY-NC 4.0. End",
        "\n\n".join(reversed(clauses)), prose.join(clauses), f"{MIT}\n{prose}\n{APACHE}", "All rights\n# reserved.", "", "SPDX-License-Identifier: GPL-2.0-only",
    ]
    assert scanned(spark, texts) == ["Apache-2.0", "", "", "CC-BY-NC-4.0", "", "", "MIT,Apache-2.0", "all-rights-reserved", "", "GPL-2.0"]
    docs = documents(spark, [*texts, *TEXTS.values()])
    same(rows_of(licenses.license_scan(docs)), oracle(licenses.sql(), docs))
    odd = odd_documents(spark)
    same(rows_of(licenses.license_scan(odd)), oracle(licenses.sql(), odd))
    assert licenses.license_scan(no_documents(spark)).count() == 0


def test_known_sentences_are_normal_and_anchored():
    for s in licenses.SENTENCES.values():
        assert licenses.normalise(s) == s and re.search(licenses._ANCHOR, s), s
    assert {i for _, ids in licenses.RULES for i in ids} | {9, 13, 21, licenses.RESERVES} >= set(licenses.SENTENCES)
