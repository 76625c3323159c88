"""Licence rules over sentence identifiers."""

from __future__ import annotations

from worldlog.llm import licenses

from . import corpus


def found(spark, text):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return row.sentence_ids, row.licenses, row.license


def test_notices_and_quoted_sentences(spark):
    assert found(spark, "x. Released under the MIT License.\nmore")[1] == "MIT"
    assert found(spark, "this work is licensed under the GNU General Public License, version 3.")[2] == "GPL-3.0"
    assert found(spark, "The MIT License is often used. Not licensed under it.") == ("", "", None)
    for id_, text in licenses.SENTENCES.items():
        assert found(spark, f"Before.\n{text}\nAfter.")[0] == id_


def test_wrapped_lines(spark):
    text = "# Permission to use, copy, modify, and/or distribute this software for any purpose\n# with or without fee is hereby granted, provided that the above copyright notice and\n# this permission notice appear in all copies.\n"
    assert found(spark, text)[1] == "ISC"
    assert found(spark, text + "\n\nReleased under the MIT License.\n")[1] == "ISC,MIT"


def test_longer_rules_claim_first(spark):
    parts = [licenses.SENTENCES[x] for x in ("grant-bsd", "source-bsd", "binary-bsd", "names-bsd")]
    assert found(spark, "\n".join(parts))[1] == "BSD-3-Clause"
    assert found(spark, "\n".join(parts[:3]))[1] == "BSD-2-Clause"
    assert found(spark, "\n".join([parts[1], parts[0], parts[2]]))[1] == ""
    both = "\n".join([*parts, "Licensed under the Apache License, Version 2.0."])
    assert found(spark, both)[1] == "BSD-3-Clause,Apache-2.0"


def test_awkward_rows(spark):
    rows = corpus.texts()
    got = licenses.scan(corpus.table(spark, rows))
    assert got.count() == len(rows)
    assert got.filter("n_sentences > 0 OR license IS NOT NULL").count() == 0
    assert licenses.scan(corpus.table(spark, [])).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Foo Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GNU = """This {} is free software{} you can redistribute it and/or
modify it under the terms of the GNU {}
General Public License as published by the Free Software
Foundation{} either version {} of the License, or
(at your option) any later version.
"""


def test_genuine_headers(spark):
    asf = "The ASF licenses this file\nto you under the Apache License, Version 2.0 (the\n\"License\");" + APACHE.split(";", 1)[1]
    other = APACHE.replace("Apache", "Educational Community").replace("apache", "example")
    cases = [
        (APACHE, "Apache-2.0"), ("".join(f" * {x}\n" for x in APACHE.splitlines()), "Apache-2.0"), (asf, "Apache-2.0"), (APACHE.split(";\n")[1], "Apache-2.0"), (other, ""),
        (BSD, "BSD-3-Clause"), (BSD.split("3. ")[0], "BSD-2-Clause"),
        (GNU.format("library", ":", "Lesser", ",", "3"), "LGPL-3.0"), (GNU.format("library", ";", "Lesser", ";", "3"), "LGPL-3.0"),
        (GNU.format("library", ";", "Lesser", ";", "2.1"), "LGPL-2.1"), (GNU.format("library", ";", "Library", ";", "2"), "LGPL-2.0"),
        (GNU.format("program", ":", "Affero", ",", "3"), "AGPL-3.0"), (GNU.format("program", ";", "Affero", ";", "3"), "AGPL-3.0"),
        (GNU.format("program", ";", "", ";", "3"), "GPL-3.0"), (GNU.format("program", ";", "", ";", "2"), "GPL-2.0"),
        ("  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"), ("  GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n", "LGPL-2.1"),
        ("   Apache License\n   Version 2.0, January 2004\n", "Apache-2.0"), ("Mozilla Public License Version 2.0\n====\n", "MPL-2.0"), ("Creative Commons Attribution-ShareAlike 4.0 International Public License\n", "CC-BY-SA-4.0"),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {i: got[i].licenses for i in got} == {i: want for i, (_, want) in enumerate(cases)}, got


def test_both_readings_count(spark):
    isc = "# Permission to use, copy, modify, and/or distribute this software for any purpose\n# with or without fee is hereby granted, provided that the above copyright notice and\n# this permission notice appear in all copies.\n"
    assert found(spark, "Released under the MIT License\nby the authors of this work\n\n" + isc)[1] == "ISC,MIT"
    assert found(spark, isc + "\n\nReleased under the MIT License\nby the authors\n")[0] == "grant-isc notice:MIT"
    assert found(spark, "Released under the MIT License\n\nReleased under the MIT License\n")[0] == "notice:MIT notice:MIT"
