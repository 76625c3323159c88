"""Operator 5, license scans: sentences become identifiers, and identifier sequences meet ordered rules. SQL only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How licences are called in notices, and the sentences of those that are quoted whole.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MIT": ("the MIT License", "the MIT licence", "MIT"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"),
    "ISC": ("the ISC License", "ISC"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "MPL-2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
}
NOTICES = (
    "Licensed under {}",
    "Released under {}",
    "Distributed under {}",
    "Published under {}",
    "Available under {}",
    "This work is licensed under {}",
    "This software is licensed under {}",
    "This project is licensed under {}",
    "This text is available under {}",
    "SPDX-License-Identifier: {}",
)
SENTENCES = {
    "grant-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "notice-mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "grant-isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "grant-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "source-bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "binary-bsd": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "names-bsd": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Single sentences beside those: parts that several grants share, the Apache header's, and openings of full texts.
_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation"
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives"}
PARTS = {
    _TERMS.format("Lesser"): "lgpl-terms",
    _TERMS.format("Library"): "library-terms",
    _TERMS.format("Affero"): "agpl-terms",
    "either version 3 of the License, or (at your option) any later version.": "later-3",
    "either version 2.1 of the License, or (at your option) any later version.": "later-2.1",
    "The ASF licenses this file to You under the Apache License, Version 2.0": "notice:Apache-2.0",
    **{f"{x}://www.apache.org/licenses/LICENSE-2.0{end}": "apache-url" for x in ("http", "https") for end in ("", ".txt")},
    **{f"You may obtain a copy of the License at {x}://www.apache.org/licenses/LICENSE-2.0": "apache-at" for x in ("http", "https")},
    "Version 2.0, January 2004": "text-apache",
    "Apache License Version 2.0, January 2004": "text-apache",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": "text-apache",
    "Mozilla Public License Version 2.0": "text-mpl",
    "GNU GENERAL PUBLIC LICENSE": "title-gpl",
    "GNU LESSER GENERAL PUBLIC LICENSE": "title-lgpl",
    "Version 3, 29 June 2007": "dated-3",
    "Version 2, June 1991": "dated-2",
    "Version 2.1, February 1999": "text-lgpl2.1",
    "Version 3, 19 November 2007": "text-agpl",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "text-gpl3",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "text-gpl2",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "text-lgpl3",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "text-lgpl2.1",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "text-agpl",
    "CC0 1.0 Universal": "text:CC0-1.0",
    **{f"{a}{x} 4.0 International{b}": f"text:{name}" for name, x in _CC.items() for a in ("", "Creative Commons ") for b in ("", " Public License")},
}
#: Rules in the order in which they claim identifiers: (licence, identifiers one after another).
RULES = (
    ("BSD-3-Clause", ("grant-bsd", "source-bsd", "binary-bsd", "names-bsd")),
    ("BSD-2-Clause", ("grant-bsd", "source-bsd", "binary-bsd")),
    ("MIT", ("grant-mit", "notice-mit")),
    ("MIT", ("grant-mit",)),
    ("ISC", ("grant-isc",)),
    ("Apache-2.0", ("notice:Apache-2.0", "apache-use", "apache-copy")),
    # other licences have a header of this shape: without a notice, the address names Apache's
    ("Apache-2.0", ("notice:Apache-2.0", "apache-use", "apache-at")),
    ("Apache-2.0", ("apache-use", "apache-copy", "apache-url")),
    ("Apache-2.0", ("apache-use", "apache-at")),
    ("Apache-2.0", ("text-apache",)),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("LGPL-3.0", ("lgpl-terms", "later-3")),
    ("LGPL-2.1", ("lgpl-terms", "later-2.1")),
    # the library licence of that name has one version
    ("LGPL-2.0", ("library-terms",)),
    ("AGPL-3.0", ("agpl3-free",)),
    ("AGPL-3.0", ("agpl-terms", "later-3")),
    ("LGPL-3.0", ("title-lgpl", "dated-3")),
    ("GPL-3.0", ("title-gpl", "dated-3")),
    ("GPL-2.0", ("title-gpl", "dated-2")),
    ("LGPL-3.0", ("text-lgpl3",)),
    ("LGPL-2.1", ("text-lgpl2.1",)),
    ("AGPL-3.0", ("text-agpl",)),
    ("GPL-3.0", ("text-gpl3",)),
    ("GPL-2.0", ("text-gpl2",)),
    ("MPL-2.0", ("text-mpl",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl2-free", "later-3")),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    *((name, (f"text:{name}",)) for name in (*_CC, "CC0-1.0")),
    *((name, (f"notice:{name}",)) for name in NAMES),
)
#: Sentences end at line ends, and at a stop or semicolon before white space.
SENTENCE_END = r"\n+|(?<=[.;:])\s+"
#: What differs from text to text goes before sentences are cut: names for short, and the holder of a BSD licence
#: (whose name may have stops). Bounded, and within a line.
PLAIN = (
    (r'(?i) ?\(the ["“\']{1,2}license["”\']{1,2}\)', ""),
    (r"(?i)neither the names? of [^\n;:]{1,200}? nor the names? of (?:its|their|any|other) contributors", "Neither the name of the copyright holder nor the names of its contributors"),
)


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def catalogue() -> dict[str, str]:
    """Normalised sentence to identifier: notices of each name, and of each quoted sentence, which inner stops part,
    the longest part that no other has."""
    known = {normal(n.format(x)): f"notice:{name}" for name, forms in NAMES.items() for x in forms for n in NOTICES}
    parted = {id_: {p for p in map(normal, re.split(SENTENCE_END, text)) if p} for id_, text in SENTENCES.items()}
    for id_, parts in parted.items():
        own = [p for p in parts if not any(p in x for other, x in parted.items() if other != id_)]
        known[max(own, key=lambda p: (len(p), p))] = id_
    return known | {normal(part): id_ for part, id_ in PARTS.items()}


def _ids(text: Column, known: dict[str, str]) -> Column:
    for pattern, plain in PLAIN:
        text = F.regexp_replace(text, pattern, plain)
    sentences = F.transform(
        F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    )
    table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    likely = F.filter(sentences, lambda s: s.isin(*known))  # a set: only hits are looked up in the map, which is searched
    return F.transform(likely, lambda s: F.element_at(table, s))


#: A line end within a paragraph goes, with the comment marks around it; a semicolon before it ends a sentence.
WRAPPED = r"(?<![\s*#/-])[\s*#/-]*\n[ \t*#/;-]*"


def sentence_ids(text: Column) -> Column:
    """The identifiers of known sentences, in the order of the text.

    Paragraphs end at blank lines. Each is read line by line, and with its lines joined (comment marks at line ends and
    beginnings go with them). Its sentences are those of the reading that has all that the other has; where either has
    sentences of its own, those of the joined reading come after those of the lines. What both find counts once.
    """
    known = catalogue()
    text = F.coalesce(text.cast("string"), F.lit(""))
    read = F.transform(
        F.split(text, r"\n\s*\n"),
        lambda p: F.struct(_ids(p, known).alias("lines"), _ids(F.regexp_replace(p, WRAPPED, " "), known).alias("joined")),
    )
    more = lambda x, y: F.array_except(x, y)
    merged = F.transform(
        read,
        lambda r: F.when(F.size(more(r["lines"], r["joined"])) == 0, r["joined"])
        .when(F.size(more(r["joined"], r["lines"])) == 0, r["lines"])
        .otherwise(F.concat(r["lines"], more(r["joined"], r["lines"]))),
    )
    return F.flatten(merged)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses (distinct, by rule), license (of the first rule) per row.

    Rules claim identifiers in order, so that a shorter rule sees only what longer ones left. Null and empty texts have
    no known sentence, no licence and a null ``license``. Rows are scanned whole and one by one: repeated rows and null
    ids stay, more columns are left alone, no rows give no rows.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    # `left` holds what no rule has claimed; a claim leaves a bar, so that sequences do not close over it
    state = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("got"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {'  '.join(ids)} ").alias("seq")) for name, ids in RULES])
    matched = F.aggregate(
        rules,
        state,
        lambda s, r: F.struct(
            F.replace(s["left"], r["seq"], F.lit(" | ")).alias("left"),
            F.when(F.contains(s["left"], r["seq"]), F.array_append(s["got"], r["name"])).otherwise(s["got"]).alias("got"),
        ),
        lambda s: F.array_distinct(s["got"]),
    )
    licenses = F.when(F.size("ids") > 0, matched).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", "ids", licenses.alias("licenses")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.get("licenses", F.lit(0)).alias("license"),
    )
