"""Licence texts as they stand in files: hard-wrapped, in comments, numbered."""

import textwrap

from loomtext.llm.licenses import OP4_SQL, RULES, SENTENCES as S, scan_licenses

from tests.compare import same


def test_wrapped_numbered_and_underlined(spark):
    bsd = [S[i].capitalize() for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")]
    clauses = [bsd[0] + ":", *(f"{i}. {c}." for i, c in enumerate(bsd[1:], 1))]
    mit = "\n\n".join(textwrap.fill(S[i] + ".", 72) for i in ("mit-grant", "mit-notice", "mit-asis"))
    comment = "/*\n * Copyright 2020 someone\n *\n" + "\n *\n".join(textwrap.indent(textwrap.fill(c, 70), " * ") for c in clauses) + "\n */"
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 someone\n\n" + mit), (2, comment), (3, "\n".join(clauses)), (4, textwrap.indent(textwrap.fill(S["gpl-free"] + ".", 60), "# ")),
        (5, "MIT License " + "=" * 3000), (6, "released under\n\nthe mit license"),
    ]
    got = sorted((r.doc_id, r.licenses) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT"), (2, "BSD-3-Clause"), (3, "BSD-3-Clause"), (4, "GPL-3.0-or-later"), (5, "MIT")]


MIT = """MIT License

Copyright (c) 2020 Some Body

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """#!/bin/sh
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
echo hello
"""
APACHE = """// Copyright 2019 Some Body
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
"""
BSD = """BSD 3-Clause License

Copyright (c) 2018, Some Body
All rights reserved.

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

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_licence_files_and_headers(spark, tmp_path, monkeypatch):
    spdx = "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;\n"
    rows = [(1, MIT), (2, GPL), (3, APACHE), (4, BSD), (5, spdx), (6, None), (7, "x " * 6000 + "\n" + MIT), (8, "Released under the MIT License " + "-" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in scan_licenses(docs).collect()}
    assert {d: x[0] for d, x in got.items()} == {1: "MIT", 2: "GPL-3.0-or-later", 3: "Apache-2.0", 4: "BSD-3-Clause", 5: "GPL-2.0-or-later", 7: "MIT", 8: "MIT"}, got
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("tests.compare.TABLES", ["documents"])
    same(scan_licenses(docs), OP4_SQL, str(tmp_path))


def test_rules_name_known_sentences():
    assert {i for _, ids in RULES for i in ids} <= set(S) and len({tuple(ids) for _, ids in RULES}) == len(RULES)
