"""Licence recognition by sentence rules.

A text becomes a sequence of normalised words, in which wrapped lines, comment signs and punctuation don't count; sentences end at a mark that white
space follows and at lines without words. Known sentences stand in them as spans of words and give their identifiers, in order; ordered rules take
sequences of identifiers and name the licences.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Sentences in one automaton; more make several.
BLOCK = 100_000

#: Known sentences of licence notices, normalised, with their identifiers.
SENTENCES = [
    ("apache-licensed", "licensed under the apache license version 2 0"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("as-is-law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-licensed", "licensed under the gnu general public license version 3"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("cc0", "licensed under cc0 1 0"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("all-rights", "all rights reserved"),
]
#: Whole sentences of the canonical notices, common variants of them, and other licences.
CANONICAL = [
    ("apache-licensed", "licensed under the apache license version 2 0 the license"),
    ("apache-licensed", "the asf licenses this file to you under the apache license version 2 0 the license"),
    ("apache-licensed", "this project is licensed under the apache license version 2 0"),
    ("apache-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("as-is-law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-licensed", "this project is licensed under the mit license"),
    ("mit-licensed", "this software is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-endorse", "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-disclaim", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense-public", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("lgpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("agpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl-received", "you should have received a copy of the gnu general public license along with this program"),
    ("mpl-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-made", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0-waived", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-work", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-work", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-work", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa-work", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-work", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("ofl-licensed", "this font software is licensed under the sil open font license version 1 1"),
]
#: Licences and the names by which notices call them, normalised.
NAMES = [
    ("MIT", ["mit license", "mit licence", "expat license"]),
    ("Apache-2.0", ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"]),
    ("BSD-2-Clause", ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"]),
    ("BSD-3-Clause", ["bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license"]),
    ("GPL-2.0", ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gpl v2"]),
    ("GPL-3.0", ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gpl v3"]),
    ("LGPL-2.1", ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgpl v2 1"]),
    ("LGPL-3.0", ["gnu lesser general public license version 3", "gnu lgpl version 3", "lgpl v3"]),
    ("AGPL-3.0", ["gnu affero general public license version 3", "gnu agpl version 3", "agpl v3"]),
    ("MPL-2.0", ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"]),
    ("EPL-2.0", ["eclipse public license version 2 0", "eclipse public license 2 0"]),
    ("ISC", ["isc license"]),
    ("Zlib", ["zlib license"]),
    ("BSL-1.0", ["boost software license version 1 0", "boost software license 1 0"]),
    ("Unlicense", ["unlicense"]),
    ("Artistic-2.0", ["artistic license 2 0", "artistic license version 2 0"]),
    ("EUPL-1.2", ["european union public licence v 1 2", "european union public license version 1 2"]),
    ("OFL-1.1", ["sil open font license version 1 1", "open font license 1 1"]),
    ("PostgreSQL", ["postgresql license"]),
]
#: What stands before such a name.
LEADS = ["licensed under the", "released under the", "distributed under the", "available under the", "published under the"]
#: Licences that a line of its own may tag, beyond those that have names.
TAGGED = ["CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-3.0", "CC-BY-SA-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "0BSD", "WTFPL", "CDDL-1.0", "MIT-0", "Python-2.0"]

#: Rules in order of precedence: licence and the identifiers that must follow each other.
RULES = [
    ("Apache-2.0", ["apache-licensed", "apache-use", "apache-copy", "as-is-law"]),
    ("Apache-2.0", ["apache-licensed", "apache-use", "apache-copy"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-redistribution"]),
    ("GPL", ["gpl-redistribute", "gpl-hope"]),
    ("LGPL", ["lgpl-redistribute", "lgpl-hope"]),
    ("LGPL", ["lgpl-redistribute"]),
    ("AGPL", ["agpl-redistribute", "gpl-hope"]),
    ("AGPL", ["agpl-redistribute"]),
    ("GPL", ["gpl-redistribute"]),
    ("ISC", ["isc-grant", "isc-disclaim"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("Unlicense", ["unlicense-public", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-public"]),
    ("WTFPL", ["wtfpl"]),
    ("MPL-2.0", ["mpl-subject", "mpl-obtain"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("EPL-2.0", ["epl-made"]),
    ("OFL-1.1", ["ofl-licensed"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl3-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-work"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-work"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-work"]),
]
#: What rights that are all reserved mean, if no rule names a licence.
RESERVED = ("proprietary", "all-rights")

#: A-Z to lower case; what is no letter, digit, code point from 128 or end of a sentence to a blank.
END = b"\x01"
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c == END[0] or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ENDS = re.compile(rb"[.!?;]+[ \t\n]|\n[^A-Za-z0-9\x80-\xff\n]*\n")


def catalogue() -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
    """The known sentences (identifier, sentence) and the ordered rules: those above, and those that names and tags give."""
    known = {}
    for identifier, sentence in SENTENCES + CANONICAL:
        known.setdefault(sentence, identifier)
    rules = list(RULES)
    for licence in [*(n for n, _ in NAMES), *TAGGED]:
        tag, named = f"tagged-{licence}".lower(), f"named-{licence}".lower()
        known.setdefault(f"spdx license identifier {normalise(licence)}", tag)
        rules.append((licence, [tag]))
        names = dict(NAMES).get(licence, [])
        for name in names:
            for lead in LEADS:
                known.setdefault(f"{lead} {name}", named)
        rules += [(licence, [named])] if names else []
    return [(identifier, sentence) for sentence, identifier in known.items()], rules


def normalise(text: str | None) -> str:
    """Words of a text, in lower case: runs of letters, digits and code points from 128, joined by blanks, END after a sentence; each character is a byte."""
    if not text:
        return ""
    data = text.encode("utf-8", "surrogatepass").replace(END, b" ").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    return b" ".join(_ENDS.sub(b" " + END + b" ", data).translate(_BYTES).split()).decode("latin-1")


def sentence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue()[0], "identifier string, sentence string")


class Recogniser:
    """Finds known sentences (sentence, identifier) as spans of words in a text. Spans that lie in another are dropped; others may overlap."""

    def __init__(self, known: Iterable[tuple[str, str]]):
        self.automaton = ahocorasick.Automaton()
        for sentence, identifier in known:
            self.automaton.add_word(f" {normalise(sentence)} ", (len(normalise(sentence)), identifier))
        self.automaton.make_automaton()

    def find(self, words: str) -> list[tuple[int, int, str]]:
        """Start, end and identifier of all spans in normalised words."""
        return [(end - length, end, identifier) for end, (length, identifier) in self.automaton.iter(f" {words} ")]


def identify(spans: list[tuple[int, int, str]]) -> list[str]:
    """Identifiers of the spans that no other one holds, in order."""
    out, reach = [], -1
    for start, end, identifier in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > reach:
            out.append(identifier)
            reach = end
    return out


def licences_of(identifiers: list[str], rules: list[tuple[str, list[str]]]) -> list[str]:
    """Licences of the rules, in their order, whose identifiers follow each other; identifiers that a rule takes are gone for later ones."""
    chain, found = "".join(f"<{i}>" for i in identifiers), []
    for name, ids in rules if identifiers else ():
        wanted = "".join(f"<{i}>" for i in ids)
        if wanted in chain:
            chain = chain.replace(wanted, "<>")
            found += [name] if name not in found else []
    return found or [RESERVED[0]] * (RESERVED[1] in identifiers)


def scan_licences(docs: DataFrame, known: DataFrame, rules: list[tuple[str, list[str]]] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` (with text), with identifiers (in order), licences (all, by precedence) and licence, the first of them (null if there is none).

    ``known``: identifier and sentence; of repeated sentences the least identifier counts, null and empty ones don't. It is a catalogue and goes through the driver, ``block`` sentences at a time,
    each block as an automaton of its own. Null and empty texts have no identifiers. Each row counts for itself. Columns of those names are replaced.
    """
    rules = catalogue()[1] if rules is None else rules
    context = docs.sparkSession.sparkContext
    known = known.where(F.col("identifier").isNotNull() & (F.length(F.trim("sentence")) > 0)).groupBy("sentence").agg(F.min("identifier").alias("identifier"))
    blocks, waiting = [], []
    for row in known.toLocalIterator():
        waiting.append((row["sentence"], row["identifier"]))
        if len(waiting) == block:
            blocks.append(context.broadcast(waiting))
            waiting = []
    blocks += [context.broadcast(waiting)] if waiting else []
    docs = docs.drop("identifiers", "licences", "licence")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("identifiers array<string>, licences array<string>, licence string").fields])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognisers = [Recogniser(b.value) for b in blocks]
        for batch in batches:
            found = []
            for text in batch.column(at):
                words = normalise(text.as_py())
                found.append(identify([span for r in recognisers for span in r.find(words)]))
            named = [licences_of(ids, rules) for ids in found]
            arrays = [pa.array(found, pa.list_(pa.string())), pa.array(named, pa.list_(pa.string())), pa.array([n[0] if n else None for n in named], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return docs.mapInArrow(scan, schema)


def op3_licences(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences (known ones), identifiers (in order), licences (all, joined by blanks) and licence of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licences(docs, sentence_table(spark)).drop("text")
    return found.select("doc_id", F.size("identifiers").cast("long").alias("n_sentences"), F.array_join("identifiers", " ").alias("identifiers"), F.array_join("licences", " ").alias("licences"), "licence")


def op3_sql() -> str:
    known, rules = catalogue()
    values = ", ".join(f"('{i}', '{s}')" for i, s in known)
    # Words stand two blanks apart, so that neighbouring sentences share none.
    steps = ["c0 AS (SELECT doc_id, n, ids, chain, [] :: VARCHAR[] AS found FROM chains)"]
    for k, (name, ids) in enumerate(rules):
        wanted = "".join(f"<{i}>" for i in ids)
        steps.append(f"c{k + 1} AS (SELECT doc_id, n, ids, replace(chain, '{wanted}', '<>') AS chain, CASE WHEN contains(chain, '{wanted}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM c{k})")
    return rf"""
WITH known(identifier, sentence) AS (VALUES {values}),
patterns AS (SELECT identifier, ' ' || replace(sentence, ' ', '  ') || ' ' AS pattern FROM known),
lines AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), chr(1), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
ended AS (SELECT doc_id, regexp_replace(t, '[.!?;]+[ \t\n]|\n[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n', ' ' || chr(1) || ' ', 'g') AS t FROM lines),
normal AS (SELECT doc_id, '  ' || trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00\x02-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) || '  ' AS words FROM ended),
split AS (SELECT doc_id, identifier, length(pattern) AS size, string_split(words, pattern) AS parts FROM normal JOIN patterns ON contains(words, pattern)),
places AS (SELECT *, unnest(range(1, len(parts))) AS k FROM split),
spans AS (SELECT doc_id, identifier, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * size AS BIGINT) AS start, size FROM places),
reach AS (SELECT doc_id, identifier, start, start + size AS finish, max(start + size) OVER (PARTITION BY doc_id ORDER BY start, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
found AS (SELECT doc_id, count(*) AS n, string_agg(identifier, ' ' ORDER BY start) AS ids, string_agg('<' || identifier || '>', '' ORDER BY start) AS chain FROM reach WHERE reached IS NULL OR finish > reached GROUP BY doc_id),
chains AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(chain, '') AS chain FROM documents LEFT JOIN found USING (doc_id)),
{', '.join(steps)},
named AS (SELECT doc_id, n, ids, CASE WHEN len(found) = 0 AND contains(' ' || ids || ' ', ' {RESERVED[1]} ') THEN ['{RESERVED[0]}'] ELSE found END AS found FROM c{len(rules)})
SELECT doc_id, n AS n_sentences, ids AS identifiers, array_to_string(found, ' ') AS licences, found[1] AS licence FROM named
"""
