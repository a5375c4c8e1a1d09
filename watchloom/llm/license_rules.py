"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences, sentences are normalised and looked up among known licence sentences, and the
sequence of identifiers found is matched against licence rules in their order: a rule that matches
consumes its sentences, so that a general rule after it can't claim them again.

Known wordings are cut by the same rule as texts. One that holds a sentence's end, such as ``...Foundation; either version 2 ...``,
is the sequence of its parts: each part has an identifier of its own, and only all of them in a row are the wording.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of public licence notices, by the identifier of the sentence they state.
SENTENCES: dict[str, list[str]] = {
    "MITgrant": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License", "The MIT License (MIT)", "The MIT License", "MIT License", "SPDX-License-Identifier: MIT"],
    "MITperm": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MITnotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "AsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "ISCname": ["ISC License", "The ISC License", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "ISCperm": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "ISCasis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "ZeroBSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: 0BSD"],
    "Apache2grant": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This project is licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "Apache2comply": ["you may not use this file except in compliance with the License"],
    "Apache2copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "Apache2asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "GPL3only": ["This work is licensed under the GNU General Public License, version 3", "This program is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL3later": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL2only": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL2later": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL21only": ["SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL21later": ["SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL3only": ["SPDX-License-Identifier: LGPL-3.0-only"],
    "LGPL3later": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL3only": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "AGPL3later": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "GPLnowarranty": [f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE" for x in ("program", "library", "software", "file")],
    "BSDgrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSDsource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSDbinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSDendorse": [f"Neither the name of the {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("copyright holder", "University", "author", "project")],
    "BSDname": ["Licensed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD2name": ["SPDX-License-Identifier: BSD-2-Clause"],
    "MPL2grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "MPL11grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")", "SPDX-License-Identifier: MPL-1.1"],
    "EPL2grant": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL1grant": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty"],
    "ZlibPerm": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "SPDX-License-Identifier: Zlib"],
    "CCBY4": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CCBYSA4": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CCBYNC4": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["Released under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "AllRights": ["All rights reserved"],
}
# The notice of the GNU licences, by the licence's name and version and the identifier without only or later.
for _name, _version, _ident in (("GNU General Public License", "2", "GPL2"), ("GNU General Public License", "3", "GPL3"), ("GNU Lesser General Public License", "2.1", "LGPL21"), ("GNU Lesser General Public License", "3", "LGPL3"), ("GNU Affero General Public License", "3", "AGPL3")):
    for _sep in ";,":
        _start = f"you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation{_sep}"
        SENTENCES[f"{_ident}later"] += [f"{_start} either version {_version} of the License, or (at your option) any later version"]
        SENTENCES[f"{_ident}only"] += [f"{_start} version {_version} of the License", f"{_start} version {_version}"]

#: Licence and the identifiers that follow each other for it, tried in this order.
RULES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"]),
    ("BSD-3-Clause", ["BSDname"]),
    ("BSD-2-Clause", ["BSD2name"]),
    ("MIT", ["MITgrant", "MITperm", "MITnotice", "AsIs"]),
    ("MIT", ["MITperm", "MITnotice", "AsIs"]),
    ("MIT", ["MITperm", "MITnotice"]),
    ("MIT", ["MITgrant"]),
    ("ISC", ["ISCname", "ISCperm", "ISCasis"]),
    ("ISC", ["ISCperm", "ISCasis"]),
    ("ISC", ["ISCperm"]),
    ("ISC", ["ISCname"]),
    ("0BSD", ["ZeroBSD"]),
    ("Apache-2.0", ["Apache2grant", "Apache2comply", "Apache2copy", "Apache2asis"]),
    ("Apache-2.0", ["Apache2grant"]),
    *((f"{name}-{how}", [f"{ident}{end}", *more]) for name, ident in (("AGPL-3.0", "AGPL3"), ("LGPL-3.0", "LGPL3"), ("LGPL-2.1", "LGPL21"), ("GPL-3.0", "GPL3"), ("GPL-2.0", "GPL2")) for how, end in (("or-later", "later"), ("only", "only")) for more in (["GPLnowarranty"], [])),
    ("MPL-2.0", ["MPL2grant"]),
    ("MPL-1.1", ["MPL11grant", "Apache2comply"]),
    ("MPL-1.1", ["MPL11grant"]),
    ("EPL-2.0", ["EPL2grant"]),
    ("BSL-1.0", ["BSL1grant"]),
    ("Unlicense", ["Unlicense"]),
    ("Zlib", ["ZlibAsIs", "ZlibPerm"]),
    ("Zlib", ["ZlibPerm"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC0-1.0", ["CC0"]),
    ("proprietary", ["AllRights"]),
]
#: Reported only where no other licence is: ``All rights reserved`` stands above many open ones too.
FALLBACK = "proprietary"

#: At a line's start: blanks, comment signs, blanks.
SIGNS = r"\n[\x20\x09]*(?:[*#/;%>|]+|--+|REM\b)?[\x20\x09]*"
#: A line that a notice's sentence doesn't go on from.
COPYRIGHT = r"(\n(?:Copyright|COPYRIGHT|\([Cc]\))[^\n]*)"
BOUNDARY = r"\n[\x20\x09]*\n|[.!?;:][\x20\x09-\x0D]+"
JUNK = r"[^a-z0-9]+"
#: So many lines, titles for example, may stand before a known sentence without ending one themselves.
TITLES = 4


def parts(wording: str) -> list[str]:
    """A wording's sentences, normalised."""
    cuts = [re.sub(JUNK, " ", p.lower()).strip() for p in re.split(BOUNDARY, wording)]
    return [p for p in cuts if p]


def known_parts(sentences: dict[str, list[str]]) -> tuple[dict[str, str], list[tuple[list[str], str]]]:
    """Identifier of each known sentence, and the sequences of identifiers, longest first, that are one wording's."""
    known = {p: ident for ident, wordings in sentences.items() for w in wordings if len(parts(w)) == 1 for p in parts(w)}
    sequences: dict[tuple[str, ...], str] = {}
    for ident, wordings in sentences.items():
        for w in wordings:
            if len(ps := parts(w)) > 1:
                for p in ps:
                    known.setdefault(p, f"{ident}/{len(known)}")
                sequences[tuple(known[p] for p in ps)] = ident
    return known, sorted(([list(s), ident] for s, ident in sequences.items()), key=lambda x: -len(x[0]))


def hint(sentences: dict[str, list[str]]) -> str:
    """Matches every text that holds a known wording: the longest word of each one's first sentence."""
    firsts = {max(parts(w)[0].split(" "), key=len) for wordings in sentences.values() for w in wordings if parts(w)}
    return "(?i)" + "|".join(sorted(firsts)) if firsts else "a^"


def normalised(sentence: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), JUNK, " "))


def sequence_text(ids: list[str]) -> str:
    return "".join(f",{i}," for i in ids)


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, list[str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
) -> DataFrame:
    """One row per row of docs: id_col, licenses (names in rule order, each once), sentence_ids (in text order), leftover (unclaimed ids).

    Comment signs at lines' starts are left out. Sentences end at . ! ? ; : before white space, at empty lines and after copyright
    lines; they may run over lines. An unknown sentence may be up to TITLES lines of titles and a known one; else its
    lines are looked up each. Sentences that aren't known say nothing, so notices may be interrupted. A rule claims every
    place where its identifiers follow each other. FALLBACK is reported only where no other licence is. Null and empty texts have
    empty lists; repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
    """
    known, sequences = known_parts(sentences)
    none = F.array().cast("array<string>")
    lookup = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))]) if known else F.create_map().cast("map<string,string>")
    find = lambda s: F.try_element_at(lookup, normalised(s))
    each = lambda lines: F.filter(F.transform(lines, find), lambda x: x.isNotNull())

    def told(sentence: Column) -> Column:
        lines = F.split(sentence, "\n")
        ways = F.when(find(sentence).isNotNull(), F.array(find(sentence)))
        for n in range(1, TITLES + 1):
            rest = F.array_join(F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0))), "\n")
            ways = ways.when((F.size(lines) > n) & find(rest).isNotNull(), F.concat(each(F.slice(lines, 1, n)), F.array(find(rest))))
        return ways.otherwise(each(lines))

    def replaced(text: Column, what: str, by: str) -> Column:
        return F.replace(text, F.lit(what), F.lit(by))

    clean = F.regexp_replace(F.concat(F.lit("\n"), F.replace(F.col(text_col), F.lit("\r"), F.lit(""))), SIGNS, "\n")
    cuts = F.split(F.regexp_replace(clean, COPYRIGHT, "$1\n"), BOUNDARY)
    a = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(hint(sentences)), F.flatten(F.transform(cuts, told))).alias("_parts"))
    ids = F.concat(F.lit(","), F.array_join("_parts", ",,"), F.lit(","))
    for seq, ident in sequences:
        ids = replaced(ids, sequence_text(seq), f",{ident},")
    whole = F.filter(F.split(ids, ","), lambda x: (x != "") & ~F.contains(x, F.lit("/")))  # parts without the rest of their wording say nothing
    whole = F.when(F.size(whole) > 0, F.concat(F.lit(","), F.array_join(whole, ",,"), F.lit(","))).otherwise("")
    a = a.select(id_col, F.when(F.size("_parts") > 0, whole).otherwise("").alias("_ids"))

    start = F.struct(F.col("_ids").alias("left"), none.alias("found"))
    order = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(sequence_text(seq)).alias("seq")) for n, seq in rules])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["seq"])
        left = F.when(hit, F.replace(acc["left"], rule["seq"], F.lit(",|,"))).otherwise(acc["left"])
        return F.struct(left.alias("left"), F.when(hit, F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    a = a.withColumn("_s", F.when(F.col("_ids") != "", F.aggregate(order, start, step)).otherwise(start))
    listed = lambda c: F.filter(F.split(c, ","), lambda x: (x != "") & (x != "|"))
    names = F.array_distinct("_s.found")
    return a.select(id_col, F.when(F.size(names) > 1, F.array_remove(names, FALLBACK)).otherwise(names).alias("licenses"), listed(F.col("_ids")).alias("sentence_ids"), listed(F.col("_s.left")).alias("leftover"))
