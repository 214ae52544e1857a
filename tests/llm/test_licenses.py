"""Licence scan over the wording that files really carry: wrapped, commented, tagged; and over odd rows."""

import textwrap

import pytest

from quarry.llm import licenses

T = licenses.TEXTS
MIT = "MIT License\n\nCopyright (c) 2024 Someone\n\n" + T["MIT_GRANT"][0] + ":\n\n" + T["MIT_KEEP"][0] + ".\n\n" + T["MIT_AS_IS"][0].upper() + ". " + T["MIT_LIABLE"][0].upper() + "."
BSD2 = "Copyright 2024 Someone. All rights reserved.\n\n" + T["BSD_OPEN"][0] + ":\n\n1. " + T["BSD_SOURCE"][0] + ".\n\n2. " + T["BSD_BINARY"][0] + ".\n\n"
BSD3 = BSD2 + "3. " + T["BSD_NAMES"][0] + ".\n\n" + T["BSD_AS_IS"][0].upper() + "."
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("program is free", "library is free").replace("General", "Lesser General").replace("version 2", "version 2.1")
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
ISC = T["ISC_GRANT"][0] + ".\n\n" + T["ISC_AS_IS"][0].upper() + "."
CASES = [("MIT", MIT), ("BSD-3-Clause", BSD3), ("GPL-3.0", GPL3), ("GPL-2.0", GPL2), ("LGPL-2.1", LGPL), ("Apache-2.0", APACHE), ("ISC", ISC)]


def _wrapped(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def _licences(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r["licences"] for r in licenses.scan(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("width,mark", [(70, ""), (60, " * "), (44, "# "), (10_000, "")])
def test_texts_of_known_licences(spark, width, mark):
    got = _licences(spark, [_wrapped(t, width, mark) for _, t in CASES])
    want = [[name] for name, _ in CASES]
    want[1] = ["BSD-3-Clause", "Proprietary"]
    assert got == want


def test_headings_tags_and_notices(spark):
    texts = ["A heading\nReleased under the MIT License.", "A heading\n" + _wrapped(T["MIT_GRANT"][0] + ": " + T["MIT_KEEP"][0] + ".", 60), "/* SPDX-License-Identifier: GPL-2.0-or-later\n * int main */", "// SPDX-License-Identifier: Apache-2.0\nimport x", "released under MIT", "The MIT License is nice"]
    assert _licences(spark, texts) == [["MIT"], ["MIT"], ["GPL-2.0"], ["Apache-2.0"], ["MIT"], []]


def test_longer_rules_take_their_sentences(spark):
    df = spark.createDataFrame([(1, BSD3), (2, BSD2), (3, BSD2 + "\n\nother software.\n\n" + BSD3)], "doc_id int, text string")
    assert [r["rules"] for r in licenses.scan(df).orderBy("doc_id").collect()] == [["BSD-3-Clause#1", "Proprietary#0"], ["BSD-2-Clause#0", "Proprietary#0"], ["BSD-2-Clause#0", "BSD-3-Clause#1", "Proprietary#0"]]


def test_every_known_sentence_is_found_and_holds_a_mark(spark):
    known = licenses.dictionary()
    assert all(any(m in s for m in licenses.MARKS) for s in known)
    assert all(licenses.normalise(s) == s for s in known if "spdx" not in s)
    sentences = sorted(known)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences) if "spdx" not in s], "doc_id int, text string")
    rows = licenses.scan(df).collect()
    assert all(",".join(r["sentence_ids"]) == known[r["text"]] for r in rows)


def test_odd_rows(spark):
    schema = "doc_id int, text string, rules string, licences string, sentence_ids string, extra int"
    rows = [(None, None, "x", "x", "x", 1), (1, "", "x", "x", "x", 2), (2, "released under MIT", "x", "x", "x", 3), (2, "released under MIT", "x", "x", "x", 3)]
    df = spark.createDataFrame(rows, schema)
    got = licenses.scan(df)
    assert sorted((r["extra"], tuple(r["licences"])) for r in got.collect()) == [(1, ()), (2, ()), (3, ("MIT",)), (3, ("MIT",))]
    assert licenses.scan(df.limit(0)).collect() == [] and sorted(got.columns) == sorted(df.columns)


@pytest.mark.parametrize("end", ["\n", ". ", " "])
def test_very_long_texts(spark, end):
    """20 MB of marked lines without one cut, of sentences, and on one line."""
    long = spark.range(1).selectExpr("cast(id as int) as doc_id", f"concat(repeat('some words about a software of no licence at all{end}', 400000), '\\n\\n') as text")
    df = long.select("doc_id", licenses.F.concat("text", licenses.F.lit(MIT)).alias("text"))
    assert [r["licences"] for r in licenses.scan(df).select("licences").collect()] == [["MIT"]]
