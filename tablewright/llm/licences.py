"""Licence scan by sentence rules.

Texts are cut into normalised sentences (words only, lower-cased); a sentence
that is known gets its identifier, and the sequence of a text's identifiers is
matched, in order, against the rules of the licences. Between two sentences of a
rule, a few others may stand. A sentence may be wrapped
over several lines: it begins at a text's start, a line's start or after a full
stop, and ends before a line's end, at a full stop or at the text's end.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Words, load, slices, text_buffer

# The wording of public licences and of usual notices.
SENTENCES: dict[str, str] = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-compliance": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-title": "The MIT License",
    "mit-title-short": "MIT License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-notice-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice-2": "This work is licensed under the GNU General Public License, version 2",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "lgpl3-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl2-url": "which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-copy-plain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-notice-3": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "rights-reserved": "All rights reserved",
}
#: Conditions of Creative Commons licences by their codes, in the order of the codes' parts.
CC_CONDITIONS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
CC_CODES = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
#: Licences that a tag may name.
TAGGED = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "AGPL-3.0-only", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "CC0-1.0", "Unlicense")
#: Rules in order of precedence: a licence and the identifiers that show it, in sequence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-notice-the", "apache2-compliance", "apache2-copy", "apache2-url", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-notice-the",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-as-is")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-condition", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-short",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-no-warranty", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-no-warranty", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-only", ("gpl-notice-3",)),
    ("GPL-2.0-only", ("gpl-notice-2",)),
    ("LGPL-3.0-or-later", ("lgpl3-later", "lgpl-no-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-no-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-no-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy-plain")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("EPL-2.0", ("epl2-notice", "epl2-url")),
    ("EPL-2.0", ("epl2-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-notice",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Apache-2.0", ("apache2-title",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("BSD-3-Clause", ("bsd-notice-3",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
)
for _code in CC_CODES:
    _said = "-".join(CC_CONDITIONS[c] for c in _code.split("-"))
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        _id, _name = f"cc-{_code}-{_version}", f"CC-{_code.upper()}-{_version}"
        SENTENCES[_id] = f"Licensed under CC {_code.upper()} {_version}"
        SENTENCES[_id + "-work"] = f"This work is licensed under a Creative Commons {_said} {_version} {_kind} License"
        SENTENCES[_id + "-work-under-the"] = f"This work is licensed under the Creative Commons {_said} {_version} {_kind} License"
        RULES += tuple((_name, (x,)) for x in (_id, _id + "-work", _id + "-work-under-the"))
for _name in TAGGED:
    SENTENCES[f"tag-{_name}"] = f"SPDX-License-Identifier: {_name}"
    RULES += ((_name, (f"tag-{_name}",)),)
#: Other known sentences that may stand between two neighbours of a rule.
GAP = 3


class SentenceBook:
    """Known sentences by their words, for lookup over a slice of texts."""

    def __init__(self, sentences: dict[str, str]):
        texts = list(sentences.values())
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        w = Words(data, offsets)
        self.by_head: dict[int, list[tuple[tuple[int, ...], list[bytes], str]]] = {}
        for k, name in enumerate(sentences):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            spelled = [w.low[s:e].tobytes() for s, e in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist())]
            self.by_head.setdefault(int(w.hash[lo]), []).append((tuple(w.hash[lo:hi].tolist()), spelled, name))
        for known in self.by_head.values():
            known.sort(key=lambda x: -len(x[0]))  # the longest sentence first
        self.heads = np.array(sorted(self.by_head), np.uint64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, str]]]:
        """For each row, (start byte, end byte, identifier) of its known sentences, in order."""
        w = Words(data, offsets)
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(offsets) - 1)]
        if not len(w.hash):
            return out
        at = np.minimum(np.searchsorted(self.heads, w.hash), len(self.heads) - 1)
        for k in np.flatnonzero(self.heads[at] == w.hash).tolist():
            row = int(w.row[k])
            lo, hi = int(w.first[row]), int(w.first[row + 1])
            begin = int(w.end[k - 1]) if k > lo else int(offsets[row])
            if k > lo and not _ends(data[begin: w.start[k]].tobytes()):
                continue
            for hashes, spelled, name in self.by_head[int(w.hash[k])]:
                n = len(hashes)
                if k + n > hi or tuple(w.hash[k: k + n].tolist()) != hashes:
                    continue
                if [w.low[s:e].tobytes() for s, e in zip(w.start[k: k + n].tolist(), w.end[k: k + n].tolist())] != spelled:
                    continue
                stop = int(w.start[k + n]) if k + n < hi else int(offsets[row + 1])
                if k + n < hi and not _ends(data[int(w.end[k + n - 1]): stop].tobytes()):
                    continue
                if out[row] and out[row][-1][1] > int(w.start[k]) - int(offsets[row]):
                    continue  # inside a longer sentence
                out[row].append((int(w.start[k]) - int(offsets[row]), int(w.end[k + n - 1]) - int(offsets[row]), name))
                break
        return out


#: What ends a sentence between two words: a line's end, a comment mark or cell
#: border, or punctuation before white space, a quote, a bracket or the text's end.
_END = re.compile(rb"[\r\n|#]|\*/|/\*|[.!?:;,](?:[ \t\")*/]|$)")


def _ends(between: bytes) -> bool:
    return _END.search(between) is not None


def _follow(identifiers: list[str], free: list[bool], rule: tuple[str, ...], first: int, gap: int) -> list[int] | None:
    """Where the rule's identifiers stand, from the first on, each at most ``gap`` others behind the one before."""
    places = [first]
    for name in rule[1:]:
        at = places[-1] + 1
        there = [k for k in range(at, min(at + gap + 1, len(identifiers))) if free[k] and identifiers[k] == name]
        if not there:
            return None
        places.append(there[0])
    return places


def match_rules(identifiers: list[str], gap: int = GAP) -> tuple[list[str], list[str]]:
    """(licences in order of first sight, identifiers that no rule used).

    Rules are tried in order of precedence; an identifier serves one rule. The
    identifiers of a rule stand in its order, at most ``gap`` others apart.
    """
    free = [True] * len(identifiers)
    there: dict[str, list[int]] = {}
    for k, name in enumerate(identifiers):
        there.setdefault(name, []).append(k)
    found: list[tuple[int, str]] = []
    for licence, rule in RULES:
        for k in there.get(rule[0], ()):
            places = _follow(identifiers, free, rule, k, gap) if free[k] else None
            if places:
                for p in places:
                    free[p] = False
                found.append((k, licence))
    return list(dict.fromkeys(name for _, name in sorted(found))), [x for x, f in zip(identifiers, free) if f]


def scan_licences(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None) -> DataFrame:
    """One row per document: id_col, licences, unmatched, sentences.

    licences: names in order of first sight, each once; sentences: structs of
    start and end byte and identifier; unmatched: identifiers of no matched
    rule. Null, empty and unlicensed texts have empty arrays; texts of any
    length are read whole; repeated rows are repeated; other columns are not
    read.
    """
    known = SENTENCES if sentences is None else sentences
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sentence", pa.string())])

    def scan(batches):
        book = SentenceBook(known)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            licences, unmatched, found = [], [], []
            for i, j in slices(offsets):
                for spans in book.find(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]):
                    names, rest = match_rules([x for _, _, x in spans])
                    licences.append(names)
                    unmatched.append(rest)
                    found.append([{"start": s, "end": e, "sentence": x} for s, e, x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(licences, pa.list_(pa.string())), pa.array(unmatched, pa.list_(pa.string())), pa.array(found, pa.list_(span))], ["id", "licences", "unmatched", "sentences"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, licences array<string>, unmatched array<string>, sentences array<struct<start:bigint,end:bigint,sentence:string>>").withColumnRenamed("id", id_col)


def op5_licences(spark, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    out = scan_licences(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), F.size("licences").cast("long").alias("n_licences"), F.size("sentences").cast("long").alias("n_sentences"), F.array_join(F.transform("sentences", lambda s: s["sentence"]), ",").alias("sentence_ids"))

