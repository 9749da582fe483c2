"""License scans by sentence rules (native DataFrame operations only).

A text is cut into sentences, each sentence is normalised, known licence sentences
are mapped to identifiers by an equi-join, and the sequence of identifiers found
in a document is matched against ordered licence rules: a rule fires when its
identifiers occur in its order. A sentence may be wrapped: lines that no mark ends
are tried alone and joined with those after them. Only sentences that can be known
(right length, beginning with two words that a known one begins with) enter the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.llm.common import columns, table

# Known licence sentences (identifier, text before normalisation).
SENTENCES = (
    ("apache2-ref", "Licensed under the Apache License, Version 2.0"),
    ("apache2-you-may-not", "you may not use this file except in compliance with the License"),
    ("apache2-obtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("mit-ref", "Released under the MIT License"),
    ("mit-ref", "Licensed under the MIT License"),
    ("mit-ref", "This project is licensed under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("as-is-caps", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-ref", "Licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl3-version", "either version 3 of the License, or (at your option) any later version"),
    ("gpl2-version", "either version 2 of the License, or (at your option) any later version"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("bsd-redist", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc4-ref", "Licensed under CC BY-NC 4.0"),
    ("cc-by4-ref", "Licensed under CC BY 4.0"),
    ("cc-by-sa4-ref", "Licensed under CC BY-SA 4.0"),
    ("cc0-ref", "Licensed under CC0 1.0"),
    ("cc-by4-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc4-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mpl2-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
    ("gpl2-ref", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl2-ref", "Licensed under the GNU General Public License, version 2"),
    ("lgpl-free", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl21-version", "either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("agpl-free", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-origin", "The origin of this software must not be misrepresented"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("epl2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cc-by-nd4-ref", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd4-ref", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("bsl1-ref", "Distributed under the Boost Software License, Version 1.0"),
)

# The sentences as whole licence texts and headers have them (identifiers in order, text before normalisation).
_GPL = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
WHOLE = (
    (("apache2-ref",), "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    (("apache2-obtain",), "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    (("apache2-as-is",), "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    (("mit-grant",), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    (("mit-notice",), "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    (("as-is-caps",), "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    (("gpl-free",), _GPL),
    *((("gpl-free", f"gpl{v}-version"), f"{head}{_GPL}, either version {v} of the License, or (at your option) any later version") for v in (2, 3) for head in ("This program is free software: ", "")),
    *((("lgpl-free", version), f"{head}{_GPL.replace('General', 'Lesser General')}, either version {v} of the License, or (at your option) any later version") for v, version in (("2.1", "lgpl21-version"), ("3", "gpl3-version")) for head in ("This library is free software: ", "This program is free software: ", "")),
    *((("agpl-free", "gpl3-version"), f"{head}{_GPL.replace('General', 'Affero General')}, either version 3 of the License, or (at your option) any later version") for head in ("This program is free software: ", "")),
    (("bsd-redist",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1"),
    (("bsd-endorse",), "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (("cc-by4-ref",), "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    (("cc-by-nc4-ref",), "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    (("cc-by-sa4-ref",), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (("cc-by-sa4-ref",), "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
)

# Short names of licences (identifier, licence, use allowed, names), hyphens as spaces.
NAMES = (
    ("mit-ref", "MIT", True, ("MIT",)),
    ("apache2-ref", "Apache-2.0", True, ("Apache 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, Version 2.0")),
    ("gpl3-ref", "GPL-3.0", False, ("GPL v3", "GPLv3", "GPL 3.0", "GPL 3.0 only", "GNU GPL v3", "GNU GPLv3", "GNU General Public License v3.0", "GNU General Public License, version 3")),
    ("gpl2-ref", "GPL-2.0", False, ("GPL v2", "GPLv2", "GPL 2.0", "GPL 2.0 only", "GNU GPL v2", "GNU GPLv2", "GNU General Public License v2.0", "GNU General Public License, version 2")),
    ("gpl3-later-ref", "GPL-3.0-or-later", False, ("GPL 3.0 or later", "GNU General Public License v3.0 or later")),
    ("gpl2-later-ref", "GPL-2.0-or-later", False, ("GPL 2.0 or later", "GNU General Public License v2.0 or later")),
    ("lgpl21-ref", "LGPL-2.1", False, ("LGPL v2.1", "LGPLv2.1", "LGPL 2.1", "LGPL 2.1 only", "GNU Lesser General Public License v2.1")),
    ("lgpl3-ref", "LGPL-3.0", False, ("LGPL v3", "LGPLv3", "LGPL 3.0", "LGPL 3.0 only", "GNU Lesser General Public License v3.0")),
    ("agpl3-ref", "AGPL-3.0", False, ("AGPL v3", "AGPLv3", "AGPL 3.0", "AGPL 3.0 only", "GNU Affero General Public License v3.0")),
    ("bsd3-ref", "BSD-3-Clause", True, ("BSD 3 Clause", "3 Clause BSD", "New BSD", "Modified BSD")),
    ("bsd2-ref", "BSD-2-Clause", True, ("BSD 2 Clause", "2 Clause BSD", "Simplified BSD")),
    ("isc-ref", "ISC", True, ("ISC",)),
    ("zlib-ref", "Zlib", True, ("zlib",)),
    ("mpl2-ref", "MPL-2.0", True, ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0")),
    ("epl2-ref", "EPL-2.0", False, ("EPL 2.0", "Eclipse Public License 2.0")),
    ("bsl1-ref", "BSL-1.0", True, ("BSL 1.0", "Boost Software License 1.0")),
    ("unlicense", "Unlicense", True, ("Unlicense",)),
    ("cc0-ref", "CC0-1.0", True, ("CC0 1.0", "CC0")),
    *((f"cc-{kind}{v}-ref", f"CC-{kind.upper()}-{v}.0", kind == "by", (f"CC {kind.replace('-', ' ')} {v}.0", f"Creative Commons {long} {v}.0 {area}"))
      for kind, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"))
      for v, area in ((3, "Unported"), (4, "International"))),
)
# How a short name is given: after one of the beginnings and articles, before one of the ends, or as a tag.
SUBJECTS = ("This work", "This file", "This project", "This software", "This program", "This library", "This code", "This document")
BEGINNINGS = tuple(f"{s}{v} under" for v in ("licensed", "released", "distributed") for s in ("", *(f"{x} is " for x in SUBJECTS)))
ARTICLES = ("", "the ")
ENDS = ("", ", see LICENSE")
TAGS = ("SPDX-License-Identifier: {}", "License: {}")


def references() -> dict[str, str]:
    """Sentences that name a licence, made of names, beginnings and ends: normalised sentence -> identifier."""
    out = {}
    for ident, _, _, names in NAMES:
        for name in names:
            forms = (name,) if "License" in name else (name, name + " License")
            out |= {normalise_text(t.format(f)): ident for t in TAGS for f in forms}
            out |= {normalise_text(f"{b} {a}{f}{e}"): ident for b in BEGINNINGS for a in ARTICLES for f in forms for e in ENDS}
    return out | {"the mit license": "mit-ref", "the mit license mit": "mit-ref", "the isc license": "isc-ref"}


# Ordered licence rules (rule, licence, use allowed, identifiers in order).
RULES = (
    ("apache2-short", "Apache-2.0", True, ("apache2-ref",)),
    ("apache2-header", "Apache-2.0", True, ("apache2-ref", "apache2-you-may-not", "apache2-as-is")),
    ("mit-short", "MIT", True, ("mit-ref",)),
    ("mit-full", "MIT", True, ("mit-grant", "mit-notice", "as-is-caps")),
    ("gpl3-short", "GPL-3.0", False, ("gpl3-ref",)),
    ("gpl3-header", "GPL-3.0-or-later", False, ("gpl-free", "gpl3-version", "gpl-warranty")),
    ("gpl2-header", "GPL-2.0-or-later", False, ("gpl-free", "gpl2-version", "gpl-warranty")),
    ("gpl2-short", "GPL-2.0", False, ("gpl2-ref",)),
    ("lgpl21-header", "LGPL-2.1-or-later", False, ("lgpl-free", "lgpl21-version", "lgpl-warranty")),
    ("lgpl3-header", "LGPL-3.0-or-later", False, ("lgpl-free", "gpl3-version")),
    ("agpl3-header", "AGPL-3.0-or-later", False, ("agpl-free", "gpl3-version")),
    ("isc-full", "ISC", True, ("isc-grant", "isc-as-is")),
    ("zlib-full", "Zlib", True, ("zlib-as-is", "zlib-origin", "zlib-altered")),
    ("epl2-short", "EPL-2.0", False, ("epl2-ref",)),
    ("cc-by-nd4-short", "CC-BY-ND-4.0", False, ("cc-by-nd4-ref",)),
    ("bsl1-short", "BSL-1.0", True, ("bsl1-ref",)),
    ("bsd3-full", "BSD-3-Clause", True, ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd2-full", "BSD-2-Clause", True, ("bsd-redist", "bsd-source", "bsd-binary")),
    ("cc-by-nc4-short", "CC-BY-NC-4.0", False, ("cc-by-nc4-ref",)),
    ("cc-by4-short", "CC-BY-4.0", True, ("cc-by4-ref",)),
    ("cc-by-sa4-short", "CC-BY-SA-4.0", False, ("cc-by-sa4-ref",)),
    ("cc0-short", "CC0-1.0", True, ("cc0-ref",)),
    ("mpl2-short", "MPL-2.0", True, ("mpl2-ref",)),
    ("unlicense-short", "Unlicense", True, ("unlicense",)),
    ("reserved-short", "all-rights-reserved", False, ("reserved",)),
)
RULES += tuple((ident.replace("-ref", "-short"), licence, ok, (ident,)) for ident, licence, ok, _ in NAMES if not any(ids == (ident,) for _, _, _, ids in RULES))

# Sentences end at a line break, or at . ; ! ? before a space or the end of the text;
# the entries above are written as these breaks would cut them.
BREAK = r"[.;!?]+(?:[\x20\x09]+|$)|[.;!?]*[\n\r]+"
LETTERS = r"[^a-z0-9]+"
# A line break after no mark: the sentence may go on. The next line is led by JOIN.
SOFT = r"(?<![.;!?\n\r])[\n\r]+"
JOIN = "\x01"


def normalise_text(text: str) -> str:
    """The plain-Python twin of :func:`normalise`, for the rule tables."""
    import re

    return re.sub(LETTERS, " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ")


KNOWN = references() | {normalise_text(s): i for i, s in SENTENCES}
#: Rows of the rule table, some thousand: normalised sentence, identifier, its place among those of the sentence.
TABLE = sorted({(s, i, 0) for s, i in KNOWN.items()} | {(normalise_text(s), i, k) for ids, s in WHOLE for k, i in enumerate(ids)})
LONGEST = max(len(s) for s, _, _ in TABLE)
SHORTEST = min(len(s) for s, _, _ in TABLE)
#: Lines that a known sentence can take: a word a line, with blank ones between.
LINES = 2 * max(len(s.split()) for s, _, _ in TABLE)
#: The first two words of a known sentence, or the first at the end of a line.
STARTS = "(?i)^[^a-z0-9]*(?:" + "|".join(sorted({"{}(?:[^a-z0-9]+{}(?![a-z0-9])|[^a-z0-9]*$)".format(*s.split()[:2]) for s, _, _ in TABLE})) + ")"
#: Every known sentence holds one of these words.
MARKS = ("license", "copyright", "software", "warranty", "rights", "redistribution", "released", "distributed")


def normalise(sentence):
    """ASCII letters and digits in lower case, single spaces between their runs."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, LETTERS, " "))


def runs(pieces, at):
    """The piece ``at`` alone, and joined with each of those after it that may go on with its sentence."""
    first = F.element_at(pieces, at + 1)
    start = F.struct(first.alias("text"), F.lit(True).alias("open"), F.array(first).alias("all"))

    def extend(had, piece):
        goes_on = had["open"] & piece.startswith(JOIN) & (F.length(F.regexp_replace(had["text"], r"[^A-Za-z0-9]+", "")) < LONGEST)
        more = F.concat(had["text"], F.lit(" "), piece)
        return F.when(goes_on, F.struct(more.alias("text"), F.lit(True).alias("open"), F.concat(had["all"], F.array(more)).alias("all"))).otherwise(
            F.struct(had["text"].alias("text"), F.lit(False).alias("open"), had["all"].alias("all"))
        )

    return F.aggregate(F.slice(pieces, at + 2, LINES - 1), start, extend, lambda had: had["all"])


def sentence_ids(docs: DataFrame) -> DataFrame:
    """row (number of the text), doc_id, pos (number from 0 of the line or sentence that it begins with), place (order
    among identifiers of one sentence), sentence_id for each known sentence."""
    spark = docs.sparkSession
    rows = columns(docs, "doc_id", "text").filter(F.col("text").rlike("(?i)" + "|".join(MARKS)))
    rows = rows.withColumn("pieces", F.split(F.regexp_replace(F.translate("text", JOIN, " "), SOFT, "\n" + JOIN), BREAK)).withColumn("row", F.monotonically_increasing_id())
    starts = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.element_at("pieces", i + 1).rlike(STARTS))
    begun = rows.select("doc_id", "row", "pieces", F.explode(starts).alias("pos"))
    cut = begun.select("doc_id", "row", "pos", F.posexplode(runs(F.col("pieces"), F.col("pos"))).alias("more", "raw"))
    norm = cut.select("doc_id", "row", "pos", (F.col("pos") + F.col("more")).alias("end"), normalise(F.col("raw")).alias("sentence"))
    norm = norm.filter(F.length("sentence").between(SHORTEST, LONGEST))
    known = spark.createDataFrame(TABLE, "sentence string, sentence_id string, place int")
    found = norm.join(F.broadcast(known), "sentence")  # the rule table: fixed size
    # a form within a longer one of the same identifier is one sentence with it
    before = Window.partitionBy("row", "sentence_id").orderBy("pos", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("reached", F.max("end").over(before)).filter("reached is null or end > reached")
    return found.select("row", "doc_id", "pos", "place", "sentence_id")


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document and licence rule that its sentences satisfy.

    A sentence may be spread over ``LINES`` lines and hold ``LONGEST`` letters and digits at
    most: twice the words, and the letters, of the longest sentence of the table, so that none of it is missed.

    Returns doc_id, rule, licence, permissive, first_pos, matches (times that the
    rule's first identifier occurs). A rule of n identifiers needs them in order,
    other sentences between them allowed. Documents without text, without a known
    sentence, or an empty table give no rows; rows that repeat a
    doc_id or have none are documents of their own, so that no rule fires across two texts;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    found = sentence_ids(docs)
    # per document and identifier only the first and last place and the count: bounded by the rule table
    per = found.groupBy("row", "doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.struct("pos", "place"))).alias("at"))
    steps = spark.createDataFrame(
        [(r, lic, ok, k, i, len(ids)) for r, lic, ok, ids in RULES for k, i in enumerate(ids)],
        "rule string, licence string, permissive boolean, step int, sentence_id string, steps int",
    )
    hit = per.join(F.broadcast(steps), "sentence_id")
    grouped = hit.groupBy("row", "doc_id", "rule", "licence", "permissive", "steps").agg(F.sort_array(F.collect_list(F.struct("step", "at", "n"))).alias("seq"))
    # walk the steps: the earliest place of each that lies after the one before, null once there is none
    reach = F.aggregate(
        F.col("seq"), F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("place")), lambda last, s: F.array_min(F.filter(s["at"], lambda p: p > last))
    )
    whole = grouped.filter((F.size("seq") == F.col("steps")) & reach.isNotNull())
    return whole.select(
        "doc_id", "rule", "licence", "permissive",
        F.col("seq")[0]["at"][0]["pos"].alias("first_pos"), F.col("seq")[0]["n"].alias("matches"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
