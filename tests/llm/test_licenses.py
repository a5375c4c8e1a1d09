"""Notices as they stand in files, wrapped and behind comment signs, each with its one right answer written by hand."""

import textwrap

import pytest

from watchloom.llm.license_rules import scan_licenses

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Copyright 2019 The Authors
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language."""
BSD2 = """Copyright (c) 2015, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
WARRANTY = "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
GPL3 = "Foobar is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, "
LGPL21 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
LATER = "either version {} of the License, or (at your option) any later version."
ISC = """The ISC License
Copyright (c) 2011 Some One
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT"""
NOTICES = [
    (MIT, ["MIT"]),
    (APACHE, ["Apache-2.0"]),
    (BSD2, ["BSD-2-Clause"]),
    (BSD3, ["BSD-3-Clause"]),
    (GPL2 + "version 2 of the License." + WARRANTY, ["GPL-2.0-only"]),
    (GPL2 + LATER.format(2) + WARRANTY, ["GPL-2.0-or-later"]),
    (GPL3.format("") + LATER.format(3) + WARRANTY, ["GPL-3.0-or-later"]),
    (GPL3.format("") + "version 3.", ["GPL-3.0-only"]),
    (GPL3.format("Lesser ") + LATER.format(3), ["LGPL-3.0-or-later"]),
    (LGPL21 + LATER.format("2.1"), ["LGPL-2.1-or-later"]),
    (LGPL21 + "version 2.1 of the License.", ["LGPL-2.1-only"]),
    (GPL3.format("Affero ") + LATER.format(3) + WARRANTY, ["AGPL-3.0-or-later"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy", ["MPL-1.1"]),
    ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', ["MPL-1.1"]),
    (ISC, ["ISC"]),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", ["BSL-1.0"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", ["Unlicense"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later\n\ncode", ["GPL-2.0-or-later"]),
    ("words without an end\nReleased under the MIT License\nAll else", ["MIT"]),
    ("Copyright 2020 X. All rights reserved.", ["proprietary"]),
    ("The license of this text is unknown. It is provided as it is; version 2 of the License.", []),
    ("This program is free software; version 3.", []),
]


def _wrapped(text, width, sign):
    lines = [x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])]
    return "\n".join((sign + x).rstrip(" ") if sign.strip() else sign + x for x in lines)


@pytest.mark.parametrize("width,sign", [(70, ""), (70, "# "), (72, " * "), (60, "// "), (10_000, ""), (40, "")])
def test_notices(spark, width, sign):
    rows = [(i, _wrapped(t, width, sign)) for i, (t, _) in enumerate(NOTICES)] + [(1000 + i, _wrapped(t, width, sign).replace("\n", "\r\n")) for i, (t, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i + o: w for o in (0, 1000) for i, (_, w) in enumerate(NOTICES)}
    assert {i: (got[i], w) for i, w in want.items() if got[i] != w} == {}


def test_own_sentences(spark):
    d = spark.createDataFrame([(1, "x. Do what you want. y"), (2, None), (1, "x. Do what you want. y"), (3, "")], "doc_id long, text string")
    got = scan_licenses(d, sentences={"W": ["Do what you want"]}, rules=[("Whatever", ["W"])]).collect()
    assert sorted((r["doc_id"], r["licenses"], r["sentence_ids"], r["leftover"]) for r in got) == [(1, ["Whatever"], ["W"], []), (1, ["Whatever"], ["W"], []), (2, [], [], []), (3, [], [], [])]
    assert scan_licenses(d.limit(0)).count() == 0
