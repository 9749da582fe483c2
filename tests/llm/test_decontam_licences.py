import re

from orderloom.llm.decontam import contaminated, decontaminate
from orderloom.llm.licences import KNOWN, MARKS, RULES, SENTENCES, TABLE, normalise_text, scan_licences
from tests.llm.helpers import DOCS, corpus, frame

ITEMS = "item_id long, text string"


def norm(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def brute(rows, items, percent=80):
    out = set()
    for item, text in items:
        w = norm(text)
        n = min(5, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for r in rows:
            d = norm(r[1])
            have = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
            if grams and 100 * len(grams & have) >= percent * len(grams):
                out.add((r[0], item, len(grams), len(grams & have)))
    return out


def test_containment_against_brute_force(spark):
    rows = corpus(4)
    long = norm(rows[-3][1])
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[500:515]) + " zz yy"), (3, "no such words in here at all"), (4, None), (5, ""), (6, rows[1][1]), (7, long[7]), (8, " ".join(long[30:33])), (9, " ".join(long[100:140]).upper() + "!")]
    for k in range(10, 40):  # items with some words changed: on both sides of the threshold
        w = long[k * 20 : k * 20 + 30]
        for j in range(k % 4):
            w[j * 8] = "changed"
        items.append((k, " ".join(w)))
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == brute(rows, items)
    bad = {g[0] for g in got}
    kept = decontaminate(frame(spark, rows, extra=False), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - bad


def test_empty_sides(spark):
    docs, none = frame(spark, corpus()), spark.createDataFrame([], ITEMS)
    assert contaminated(docs, none).count() == 0
    assert contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0


def test_known_sentences_survive_the_breaks():
    from orderloom.llm.licences import BREAK

    for _, s in SENTENCES:
        assert len([x for x in re.split(BREAK, s) if x]) == 1, s
        assert any(m in s.lower() for m in MARKS), s
        assert normalise_text(s) in KNOWN
    assert {i for _, _, _, ids in RULES for i in ids} <= {i for _, i, _ in TABLE}


def test_licence_rules(spark):
    bsd = [s for i, s in SENTENCES if i.startswith("bsd-")]
    rows = [
        (1, "Some words. Released under the MIT License.\nMore words", None, None, None),
        (2, "\n".join(bsd) + ".", None, None, None),
        (3, "\n".join(reversed(bsd)), None, None, None),
        (4, None, None, None, None), (5, "", None, None, None),
        (6, "licensed UNDER the apache license; version 2.0", None, None, None),
        (7, "x " * 5000 + ". Licensed under the Apache License, Version 2.0.", None, None, None),
        (8, "Released under the MIT License.\nReleased under the MIT License.", None, None, None),
    ]
    got = {(r.doc_id, r.rule, r.matches) for r in scan_licences(frame(spark, rows)).collect()}
    assert got == {(1, "mit-short", 1), (2, "bsd3-full", 1), (2, "bsd2-full", 1), (7, "apache2-short", 1), (8, "mit-short", 2)}
    assert scan_licences(spark.createDataFrame([], DOCS)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Some One

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
LIABILITY.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
BSD3 = """Copyright (c) 2020, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
LGPL3 = GPL3.replace("GNU General", "GNU Lesser General")
AGPL3 = GPL3.replace("GNU General", "GNU Affero General")
ISC = """Copyright (c) 2020 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
"""
EPL2 = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
BSL1 = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt)
"""


def brute_rules(text):
    """The rules over every run of lines and sentences, in plain Python: pieces end at marks; lines that no mark ends may go on."""

    known = {}
    for s, i, place in TABLE:
        known.setdefault(s, []).append((place, i))
    soft = re.sub(r"(?<![.;!?\n\r])[\n\r]+", "\n\x01", text or "")
    pieces, found = re.split(r"[.;!?]+(?:[ \t]+|$)|[.;!?]*[\n\r]+", soft), []
    for a in range(len(pieces)):
        for b in range(a + 1, len(pieces) + 1):
            if b > a + 1 and not pieces[b - 1].startswith("\x01"):
                break
            for place, i in known.get(normalise_text(" ".join(pieces[a:b])), ()):
                found.append((a, b, place, i))
    # a form within a longer one of its identifier is one sentence with it
    found = [f for f in found if not any(g[3] == f[3] and g != f and g[0] <= f[0] and f[1] <= g[1] for g in found)]
    out = set()
    for rule, _, _, ids in RULES:
        last = (-1, 0)
        for want in ids:
            last = min(((a, p) for a, _, p, i in found if i == want and last and (a, p) > last), default=None)
            if last is None:
                break
        if last:
            out.add((rule, len({f[:2] for f in found if f[3] == ids[0]})))
    return out


def test_rules_against_brute_force(spark):
    import random

    rng, rows = random.Random(8), []
    whole = [APACHE, MIT, GPL3, GPL2, BSD3, LGPL21, LGPL3, AGPL3, ISC, ZLIB, EPL2, BSL1]
    single = [s + rng.choice([".", ";", "", "\n", ". "]) for _, s in SENTENCES]
    for i in range(150):
        bits = [rng.choice(whole) if rng.random() < 0.3 else rng.choice(single) if rng.random() < 0.7 else "some other words. And more" for _ in range(rng.randint(1, 6))]
        text = rng.choice(["\n", " ", "\n\n", ". "]).join(bits)
        if rng.random() < 0.3:
            text = re.sub(r"(?<=[a-z]) (?=[a-z])", lambda m: rng.choice([" ", " ", "\n"]), text)
        rows.append((i, text, None, None, None))
    got = {}
    for r in scan_licences(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.rule, r.matches))
    for i, text, *_ in rows:
        assert got.get(i, set()) == brute_rules(text), text


def test_whole_licence_texts(spark):
    texts = {
        "apache": (APACHE, {"apache2-short", "apache2-header"}), "mit": (MIT, {"mit-full"}), "gpl3": (GPL3, {"gpl3-header"}),
        "gpl2": (GPL2, {"gpl2-header"}), "bsd": (BSD3, {"reserved-short", "bsd3-full", "bsd2-full"}),
        "lgpl21": (LGPL21, {"lgpl21-header"}), "lgpl3": (LGPL3, {"lgpl3-header"}), "agpl3": (AGPL3, {"agpl3-header"}), "isc": (ISC, {"isc-full"}), "zlib": (ZLIB, {"zlib-full"}),
        "epl2": (EPL2, {"epl2-short"}), "bsl1": (BSL1, {"bsl1-short"}),
    }
    rows, want = [], set()
    for k, (text, rules) in enumerate(texts.values()):
        plain = re.sub(r"(?<!\n)\n(?!\n)[ ]*", " ", text)  # a paragraph a line
        forms = [text, plain, text.replace("\n", "\r\n"), re.sub("(?m)^", " * ", text), re.sub("(?m)^", "// ", text), re.sub(r"(?<!\n)[ ]+", "\n", text.replace("\n\n", "\n"))]
        rows += [(100 * k + i, f, None, None, None) for i, f in enumerate(forms)]
        want |= {(100 * k + i, r, 1) for i in range(len(forms)) for r in rules}
    assert {(r.doc_id, r.rule, r.matches) for r in scan_licences(frame(spark, rows)).collect()} == want


def test_short_references_and_tags(spark):
    said = {
        "SPDX-License-Identifier: MIT": "mit-short", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl3-later-short", "The MIT License (MIT)": "mit-short", "Licensed under the Apache License 2.0.": "apache2-short",
        "Licensed under the GPL v3.": "gpl3-short", "Licensed under CC BY 3.0.": "cc-by3-short", "This work is licensed under CC-BY-SA-4.0.": "cc-by-sa4-short", "This file is released under the MIT license, see LICENSE.": "mit-short",
        "Some code. This software is distributed\nunder the BSD 3-Clause License. More code": "bsd3-short", "License: ISC": "isc-short", "We like the MIT campus and its license plates.": None, "Licensed under the moon": None,
    }
    rows = [(i, t, None, None, None) for i, t in enumerate(said)]
    got = {r.doc_id: r.rule for r in scan_licences(frame(spark, rows)).collect()}
    assert got == {i: r for i, r in enumerate(said.values()) if r}


def test_every_known_sentence_passes_the_filter_of_documents(spark):
    assert [s for s, _, _ in TABLE if not any(m in s for m in MARKS)] == []
    said = {"Released under MIT.": "mit-short", "This code is distributed under the GPLv3.": "gpl3-short", "This work is released\nunder CC BY 4.0": "cc-by4-short"}
    rows = [(i, t, None, None, None) for i, t in enumerate(said)]
    assert {r.doc_id: r.rule for r in scan_licences(frame(spark, rows)).collect()} == dict(enumerate(said.values()))
