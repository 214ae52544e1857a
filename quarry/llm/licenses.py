"""Licence scan by sentence rules: sentences become known identifiers, identifier sequences match ordered rules.

A text is cut after ``.``, ``!``, ``?``, ``:`` or ``;`` followed by white space, and at lines without a letter or digit, so
a sentence that is wrapped over lines (with comment marks in front of them, if need be) stays whole. Each sentence is
normalised (A-Z lowered, everything but a-z, 0-9 and ``.`` inside numbers and words dropped to single spaces) and looked
up in the dictionary of known licence sentences. Where a wrapped sentence is unknown, a heading may stand right above a
notice, or unmarked lines below it: then each of its lines is looked up alone, and of its ends (the last lines together,
two or more, up to the longest known sentence) the longest known one.

The identifiers found, in order, form a sequence. Rules are tried from the longest on; a rule matches where its
identifiers stand side by side, and takes them, so a rule that lies inside a longer matching one is not reported there.

All work is narrow: one expression per row and no shuffle. Sentences are cut in marked texts only, and normalised only if
they hold a mark, so memory beyond the text is its sentences once. The dictionary and the rules are fixed, small tables.

Defined results: null or empty text, or one without known sentences, gives no licence (empty arrays); repeats of a
licence are reported once; extra input columns pass through, columns named as the outputs are replaced.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let

# Names of public licences as their short notices give them.
NAMES = {
    "MIT": ["the MIT license", "MIT license", "MIT", "the terms of the MIT license"],
    "ISC": ["the ISC license", "ISC"],
    "Apache-2.0": ["the Apache license, version 2.0", "the Apache license 2.0", "Apache license 2.0", "Apache 2.0", "the terms of the Apache license, version 2.0"],
    "GPL-2.0": ["the GNU general public license, version 2", "the GNU general public license v2.0", "the GNU GPL v2", "the GPL version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["the GNU general public license, version 3", "the GNU general public license v3.0", "the GNU GPL v3", "the GPL version 3", "GPL-3.0", "GPLv3"],
    "LGPL-2.1": ["the GNU lesser general public license, version 2.1", "LGPL-2.1", "LGPLv2.1"],
    "LGPL-3.0": ["the GNU lesser general public license, version 3", "LGPL-3.0", "LGPLv3"],
    "AGPL-3.0": ["the GNU affero general public license, version 3", "AGPL-3.0", "AGPLv3"],
    "MPL-2.0": ["the Mozilla public license, version 2.0", "the Mozilla public license 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse public license, version 2.0", "the Eclipse public license 2.0", "EPL-2.0"],
    "BSD-2-Clause": ["the BSD 2-clause license", "the 2-clause BSD license", "the simplified BSD license", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-clause license", "the 3-clause BSD license", "the new BSD license", "BSD-3-Clause"],
    "BSL-1.0": ["the Boost software license, version 1.0", "BSL-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the CC BY 4.0 license", "a creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the CC BY-SA 4.0 license", "a creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the CC BY-NC 4.0 license", "a creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a creative commons attribution-noderivatives 4.0 international license"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "Unlicense": ["the unlicense"],
}
# What a short notice says before the name.
NOTICES = ["licensed under", "released under", "distributed under", "published under", "available under", "is licensed under", "this work is licensed under", "this project is licensed under", "this software is licensed under", "this software is released under", "this program is licensed under", "this code is licensed under", "this file is licensed under", "this document is licensed under", "this project is released under", "this software is distributed under"]
# Sentences of public licence texts and of their customary headers.
TEXTS = {
    "APACHE2_ABIDE": ["you may not use this file except in compliance with the license"],
    "APACHE2_COPY": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"],
    "APACHE2_AS_IS": ["unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"],
    "FREE_SOFTWARE": ["this program is free software", "this library is free software", "this file is free software"],
    "GPL_TERMS": ["you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "LGPL_TERMS": ["you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "AGPL_TERMS": ["you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "LATER_2": ["either version 2 of the license, or (at your option) any later version"],
    "LATER_2_1": ["either version 2.1 of the license, or (at your option) any later version"],
    "LATER_3": ["either version 3 of the license, or (at your option) any later version"],
    "MPL2_TERMS": ["this source code form is subject to the terms of the mozilla public license, v"],
    "MPL2_COPY": ["if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/", "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/"],
    "MIT_GRANT": ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"],
    "MIT_KEEP": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software"],
    "MIT_AS_IS": ["the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
    "MIT_LIABLE": ["in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"],
    "ISC_GRANT": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "ISC_AS_IS": ["the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "0BSD_GRANT": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "BSD_OPEN": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD_SOURCE": ["redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSD_BINARY": ["redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSD_NAMES": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD_AS_IS": ["this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "ZLIB_GRANT": ["permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "BOOST_GRANT": ["permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following"],
    "PUBLIC": ["this is free and unencumbered software released into the public domain"],
    "RESERVED": ["all rights reserved"],
}
# Ordered rules over the identifiers; notices and SPDX tags have a rule of their own per licence.
RULES = {
    "MIT": [["MIT_GRANT", "MIT_KEEP"], ["MIT_GRANT", "MIT_KEEP", "MIT_AS_IS"], ["MIT_GRANT", "MIT_KEEP", "MIT_AS_IS", "MIT_LIABLE"]],
    "ISC": [["ISC_GRANT"], ["ISC_GRANT", "ISC_AS_IS"]],
    "0BSD": [["0BSD_GRANT"], ["0BSD_GRANT", "ISC_AS_IS"]],
    "Apache-2.0": [["NOTE_Apache-2.0", "APACHE2_ABIDE"], ["NOTE_Apache-2.0", "APACHE2_ABIDE", "APACHE2_COPY"], ["NOTE_Apache-2.0", "APACHE2_ABIDE", "APACHE2_COPY", "APACHE2_AS_IS"]],
    "GPL-2.0": [["FREE_SOFTWARE", "GPL_TERMS", "LATER_2"]],
    "GPL-3.0": [["FREE_SOFTWARE", "GPL_TERMS", "LATER_3"]],
    "LGPL-2.1": [["FREE_SOFTWARE", "LGPL_TERMS", "LATER_2_1"]],
    "LGPL-3.0": [["FREE_SOFTWARE", "LGPL_TERMS", "LATER_3"]],
    "AGPL-3.0": [["FREE_SOFTWARE", "AGPL_TERMS", "LATER_3"]],
    "MPL-2.0": [["MPL2_TERMS"], ["MPL2_TERMS", "MPL2_COPY"]],
    "BSD-2-Clause": [["BSD_OPEN", "BSD_SOURCE", "BSD_BINARY"], ["BSD_OPEN", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS"]],
    "BSD-3-Clause": [["BSD_OPEN", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"], ["BSD_OPEN", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES", "BSD_AS_IS"]],
    "Zlib": [["ZLIB_GRANT"]],
    "BSL-1.0": [["BOOST_GRANT"]],
    "Unlicense": [["PUBLIC"]],
    "Proprietary": [["RESERVED"]],
}
#: Every known sentence holds one of these, so other texts and sentences need no cutting and no normalising.
MARKS = ("licen", "permission", "copyright", "software", "redistribut", "reserved", "mpl was not", "released under", "distributed under", "published under", "available under")
SPDX = "spdx-license-identifier:"
CUT = r"(?<=[.!?:;])[\x20\x09-\x0D]+|\n(?:[^A-Za-z0-9\n]*\n)+"


def normalise(sentence: str) -> str:
    """Normal form of one sentence."""
    plain = re.sub(r"[^a-z0-9.]+", " ", "".join(c.lower() if c.isascii() else " " for c in sentence))
    return re.sub(r"(?:\.(?= |$))|(?:(?<= )\.)|^\.", "", plain).strip(" ")


def dictionary() -> dict[str, str]:
    """Normal form and identifier of every known sentence: short notices and SPDX tags by rule, and the texts above."""
    found = {f"{n} {name}{end}": f"NOTE_{lic}" for lic, names in NAMES.items() for name in names for n in NOTICES for end in ("", ' (the "license")')}
    late = {"-2.0": 1, "-3.0": 1, "-2.1": 1}
    found |= {f"{SPDX}{lic}{v}": f"SPDX_{lic}" for lic in (*NAMES, *RULES) if lic != "Proprietary" for v in ("", *(("-only", "-or-later") if "GPL" in lic and lic[-4:] in late else ()))}
    found |= {s: i for i, ss in TEXTS.items() for s in ss}
    found |= {f"{TEXTS[k + '_TERMS'][0]}, {TEXTS[v][0]}": f"{k}_TERMS,{v}" for k in ("GPL", "LGPL", "AGPL") for v in ("LATER_2", "LATER_2_1", "LATER_3")}
    return {normalise(s): i for s, i in found.items()}


def rule_keys(rules: dict[str, list[list[str]]]) -> list[tuple[str, str]]:
    """(rule name, its identifiers each between commas), longest first."""
    keys = [(f"{lic}#{i}", "".join(f",{x}," for x in r), len(r)) for lic, rs in rules.items() for i, r in enumerate(rs)]
    return [(n, k) for n, k, size in sorted(keys, key=lambda x: (-x[2], x[0]))]


def all_rules() -> dict[str, list[list[str]]]:
    """The rules above, and per licence one for its short notice and one for its SPDX tag."""
    found = {lic: list(rs) for lic, rs in RULES.items()}
    for lic in NAMES:
        found.setdefault(lic, []).append([f"NOTE_{lic}"])
    for lic in dict.fromkeys((*NAMES, *RULES)):
        if lic != "Proprietary":
            found[lic].append([f"SPDX_{lic}"])
    return found


def plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9.]+", " "), r"(?:\.(?= |$))|(?:(?<= )\.)|^\.", ""))


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """``docs`` with ``sentence_ids`` (identifiers in order), ``rules`` (matched ``licence#i``) and ``licences`` added.

    ``known`` maps normal forms to identifiers (several, joined by commas, for a sentence that stands for a sequence), each
    of which holds one of ``marks``.
    """
    known, rules = known or dictionary(), rules or all_rules()
    longest = max(map(len, known), default=0)
    none = F.array().cast("array<string>")
    lookup = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    holds = lambda s: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(s, m))
    one = lambda s: F.split(F.try_element_at(lookup, plain(s)), ",")

    def wrapped(sentence: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            # A line holds a letter or digit (else it is a cut), so a known sentence ends on few enough of the last lines.
            n, first = F.size(lines), F.greatest(F.lit(2), F.size(lines) - (longest + 1) // 2 + 1)
            signs = F.transform(F.slice(lines, first, n), lambda s: F.length(F.regexp_replace(s, "[^A-Za-z0-9]", "")))
            starts = F.when(first < n, F.sequence(first, n - 1)).otherwise(F.array().cast("array<int>"))
            short = let(signs, lambda c: F.filter(starts, lambda k: F.aggregate(F.slice(c, k - first + 1, n), F.lit(0), lambda acc, x: acc + x) <= longest))
            tails = F.transform(short, lambda k: F.struct(k.alias("k"), F.try_element_at(lookup, plain(F.array_join(F.slice(lines, k, n), " "))).alias("id")))
            tail = F.try_element_at(F.filter(tails, lambda t: t["id"].isNotNull()), F.lit(1))
            single = lambda stop: F.flatten(F.filter(F.transform(F.filter(F.slice(lines, 1, stop), lambda s: let(F.lower(s), holds)), one), lambda x: x.isNotNull()))
            return let(tail, lambda t: F.when(t.isNull(), single(n)).otherwise(F.concat(single(t["k"] - 1), F.split(t["id"], ","))))

        return F.when(F.contains(sentence, F.lit("\n")), let(F.split(sentence, "\n"), of_lines)).otherwise(none)

    def ids(text: Column) -> Column:
        joined = F.when(F.contains(F.lower(text), F.lit(SPDX)), F.regexp_replace(text, f"(?i)({SPDX})[ \\t]+", "$1")).otherwise(text)
        pieces = F.filter(F.split(joined, CUT), lambda s: let(F.lower(s), holds))
        return F.flatten(F.transform(pieces, lambda s: let(one(s), lambda got: F.coalesce(got, wrapped(s)))))

    seen = docs.withColumn("sentence_ids", F.when(let(F.lower("text"), holds), ids(F.col("text"))).otherwise(none))
    table = F.from_json(F.lit(json.dumps([{"n": n, "k": k} for n, k in rule_keys(rules)])), "array<struct<n:string,k:string>>")
    chain = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    start = F.struct(chain.alias("chain"), none.alias("hits"))

    def take(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["chain"], rule["k"])
        return F.struct(
            F.when(hit, F.replace(acc["chain"], rule["k"], F.lit(",-,"))).otherwise(acc["chain"]).alias("chain"), F.when(hit, F.concat(acc["hits"], F.array(rule["n"]))).otherwise(acc["hits"]).alias("hits")
        )

    matched = F.when(F.size("sentence_ids") > 0, F.array_sort(F.aggregate(table, start, take, lambda acc: acc["hits"]))).otherwise(none)
    with_rules = seen.withColumn("rules", matched)
    return with_rules.withColumn("licences", F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.substring_index(r, "#", 1)))))
