"""Whole canonical notices, wrapped and unwrapped."""

import textwrap

import pytest

from tidemark.llm import licences

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = """Copyright (c) 2020 Anna

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Copyright (c) 2020, Anna

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
BSD3 = BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + WARRANTY
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
NOTICES = {
    "apache": (APACHE, "Apache-2.0", ["apache-licensed", "apache-use", "apache-copy", "as-is-law"]),
    "mit": (MIT, "MIT", ["mit-grant", "mit-notice", "as-is"]),
    "bsd2": (BSD2 + WARRANTY, "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    "bsd3": (BSD3, "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "gpl2": (GPL2, "GPL", ["gpl-redistribute", "gpl-hope"]),
    "gpl3": (GPL3, "GPL", ["gpl-redistribute", "gpl-hope"]),
}


def wrapped(text, width, prefix="", end="\n"):
    return end.join((prefix + line).rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


@pytest.mark.parametrize("name", NOTICES)
def test_whole_notices(spark, name):
    text, licence, identifiers = NOTICES[name]
    forms = [text, *(wrapped(text, w) for w in (30, 60, 76)), wrapped(text, 70, "# "), wrapped(text, 70, " * ", "\r\n"), " ".join(text[text.index("\n\n") if text.startswith("Copyright") else 0 :].split()), f"Some words\nbefore it\n{wrapped(text, 64)}\nand words after"]
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    for r in licences.scan_licences(docs, licences.sentence_table(spark)).orderBy("doc_id").collect():
        assert (r["licence"], r["identifiers"]) == (licence, identifiers), forms[r["doc_id"]]


def test_sentences_end_at_marks_and_blank_lines(spark):
    texts = ["Released under\nthe MIT License", "Released under\n\nthe MIT License", "Released under\n--\nthe MIT License", "Released under. the MIT License", "not Released under the MIT License", "no mark\nReleased under the MIT License\nno mark", "Released under the MIT License of old", "This work is\nlicensed under the GNU General Public License, version 3.", "a\x01Released under the MIT License", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["identifiers"] for r in licences.scan_licences(docs, licences.sentence_table(spark)).orderBy("doc_id").collect()]
    assert found == [["mit-released"], [], [], [], ["mit-released"], ["mit-released"], ["mit-released"], ["gpl3-work"], ["mit-released"], [], []]


def test_known_sentences_that_begin_alike(spark):
    known = spark.createDataFrame([("ab", "a b"), ("abc", "a b c"), ("abd", "a b d"), ("x", "x"), ("bc", "b c"), ("zz", "a b"), (None, "q"), ("url", "see http q r s b")], "identifier string, sentence string")
    docs = spark.createDataFrame([(0, "a b\nc"), (1, "a b\nd. x"), (2, "a\nb\ne. b c"), (3, "a b. x\nx\nb\nc"), (4, "see http://q.r/s b")], "doc_id long, text string")
    found = [r["identifiers"] for r in licences.scan_licences(docs, known, []).orderBy("doc_id").collect()]
    assert found == [["abc"], ["abd", "x"], ["ab", "bc"], ["ab", "x", "x", "bc"], ["url"]]
    assert [r["identifiers"] for r in licences.scan_licences(docs, known.limit(0)).collect()] == [[]] * 5


@pytest.mark.parametrize("block", [7, 100_000])
def test_all_licences_of_a_text(spark, block):
    expected = [
        ("Licensed under the Apache License, Version 2.0. Parts are released under the\nMIT license.", "Apache-2.0 MIT"),
        ("This code is licensed under the MIT license.", "MIT"),
        (APACHE + "\n\n" + MIT + "\n\n" + BSD3, "Apache-2.0 MIT BSD-3-Clause"),
        (BSD3 + "\nAll rights reserved.", "BSD-3-Clause"),
        ("Copyright 2020 Anna. All rights reserved.", "proprietary"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint main;", "GPL-2.0-or-later"),
        ("# SPDX-License-Identifier: MIT", "MIT"),
        ("distributed under the Mozilla Public License, version 2.0", "MPL-2.0"),
        (GPL3.replace("General", "Lesser General").replace("This program is dist", "This library is dist"), "LGPL"),
        ("Licensed under the GNU Affero General Public License, Version 3; and under the BSD 2-Clause License, too", "AGPL-3.0"),
        ("nothing known", ""),
    ]
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(expected)], "doc_id long, text string")
    found = licences.scan_licences(docs, licences.sentence_table(spark), block=block).orderBy("doc_id").collect()
    assert [" ".join(r["licences"]) for r in found] == [names for _, names in expected]
    assert [r["licence"] for r in found] == [names.split(" ")[0] or None for _, names in expected]


def test_the_catalogue():
    known, rules = licences.catalogue()
    assert len(known) > 200 and len({s for _, s in known}) == len(known)
    assert {i for _, ids in rules for i in ids} <= {i for i, _ in known} and all(licences.normalise(s) == s for _, s in known)
