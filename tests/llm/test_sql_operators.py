import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import licenses, mixing
from lodestrata.llm.queries import ORACLE, QUERIES


def rows_of(con, sql, columns):
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    return sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = QUERIES[name](spark, sf_dir)
    assert sorted(repr(tuple(r)) for r in got.collect()) == rows_of(con, ORACLE[name], got.columns)


MIT = "\n".join(licenses.SENTENCES[i][0].capitalize() + "." for i in ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABILITY"))

MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE_HEADER = """/*
 * Copyright 2020 Some Company
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
int main() {}
"""
BSD_FILE = """Copyright (c) 2001, Some University
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some University nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.

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
GPL_HEADER = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL_HEADER = "# This Source Code Form is subject to the terms of the Mozilla Public\r\n# License, v. 2.0. If a copy of the MPL was not distributed with this\r\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.\r\n"
ISC_FILE = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
AGPL_TEXT = """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU Affero General Public License is a free, copyleft license for
software and other kinds of works, specifically designed to ensure
cooperation with the community in the case of network server software.
"""
FILES = {
    "MIT_FILE": (MIT_FILE, "MIT_TITLE,MIT_GRANT,MIT_NOTICE,MIT_AS_IS,MIT_LIABILITY", "MIT"),
    "APACHE_HEADER": (APACHE_HEADER, "APACHE2_REF,APACHE2_COMPLY,APACHE2_URL,APACHE2_AS_IS,APACHE2_SEE", "Apache-2.0"),
    "BSD_FILE": (BSD_FILE, "BSD_GRANT,BSD_SOURCE,BSD_BINARY,BSD_ENDORSE,BSD_AS_IS,BSD_LIABILITY", "BSD-3-Clause"),
    "GPL_HEADER": (GPL_HEADER, "GPL3_PLUS_GRANT,GPL_WARRANTY,GPL_SEE,GPL_COPY", "GPL-3.0-or-later"),
    "MPL_HEADER": (MPL_HEADER, "MPL2_REF,MPL2_COPY", "MPL-2.0"),
    "ISC_FILE": (ISC_FILE, "ISC_GRANT,ISC_AS_IS,ISC_LIABILITY", "ISC"),
    "AGPL_TEXT": (AGPL_TEXT, "AGPL3_TITLE,GNU_VERBATIM,AGPL_FREE_COPYLEFT", "AGPL-3.0"),
    "SPDX": ("// SPDX-License-Identifier: Apache-2.0\ncode", "APACHE2_TITLE", "Apache-2.0"),
    "PROSE": ("prose without a stop\nReleased under the MIT License.\nmore prose; no stop", "MIT_REF", "MIT"),
    "ONE_LINE": (" ".join(MIT_FILE.split()), "MIT_NOTICE,MIT_AS_IS,MIT_LIABILITY", ""),  # names run into the grant
}


def test_licenses_as_real_files_wrap_them(spark, tmp_path):
    rows = [(k, text) for k, (text, _, _) in enumerate(FILES.values())]
    rows += [(100 + k, "\n".join("// " + line for line in text.splitlines())) for k, text in rows[:7]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan_licenses(df).collect()}
    assert got == {k: v[1:] for k, v in enumerate(FILES.values())} | {100 + k: v[1:] for k, v in enumerate(list(FILES.values())[:7])}
    # the SQL finds the same
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    out = licenses.scan_licenses(df)
    assert sorted(repr(tuple(r)) for r in out.collect()) == rows_of(con, licenses.op6_sql(), out.columns)


def test_the_table_is_within_bounds():
    every = [s for group in licenses.SENTENCES.values() for s in group]
    assert len(set(every)) == len(every) <= 200
    assert all(i in licenses.SENTENCES for _, run in licenses.RULES for i in run)


def test_license_rules(spark):
    rows = [
        (1, None, "", "", ""),
        (2, "", "", "", ""),
        (3, "Prose. Licensed under the Apache License, Version 2.0. More prose! Released under  the MIT License.", "APACHE2_REF,MIT_REF", "MIT,Apache-2.0", ""),
        (4, MIT, "MIT_GRANT,MIT_NOTICE,MIT_AS_IS,MIT_LIABILITY", "MIT", ""),
        (5, "See the GNU General Public License for more details.", "GPL_SEE", "", "GPL_SEE"),
        (None, "x " * 200_000 + "\nLicensed under CC BY-NC 4.0.", "CC_BY_NC_4_REF", "CC-BY-NC-4.0", ""),
        (6, "Not licensed under the MIT license here. Released under the MIT License, or not", "", "", ""),
        (6, "Released under the MIT License.\nReleased under the MIT License.", "MIT_REF,MIT_REF", "MIT", ""),
    ]
    df = spark.createDataFrame([(*r[:2], "s", 1) for r in rows], "doc_id long, text string, s0 string, licenses int")
    got = sorted((r.doc_id or 0, r.sentence_ids, r.licenses, r.unmatched) for r in licenses.scan_licenses(df).collect())
    assert got == sorted((r[0] or 0, *r[2:]) for r in rows)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s1", 1000), ("b", "en", "s1", 1000), ("b", "en", None, 1000)]
    mix = mixing.Mix(domains={"a": 1, "b": 1}, languages={"en": 1, "de": 1}, default=1, per_mille=400, max_epochs=1)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, mix).collect()}
    # 4,010 tokens, 1,604 to give: 802 a domain, 401 a language of a; s1's shortage stays in a/en
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 391, ("a", "de", "s1"): 401, ("b", "en", "s1"): 401, ("b", "en", None): 401}
    short = mixing.Mix(domains={"a": 3, "b": 1}, languages={"en": 1, "de": 1}, default=1, per_mille=900, max_epochs=1)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, short).collect()}
    assert sum(v for k, v in got.items() if k[0] == "a") == 2010 and sum(v for k, v in got.items() if k[0] == "b") in (1598, 1599)


@pytest.mark.parametrize("mix", [mixing.Mix(per_mille=900, max_epochs=3), mixing.Mix(languages={"en": 0, "fr": 5}, sources={"src1": 0}, domains={"domain2": 0}), mixing.Mix(per_mille=100, default=0, languages={"de": 3}, sources={"src3": 2, "src7": 1}, domains={"domain3": 1})])
def test_other_mixes_against_sql(spark, sf_dir, mix):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix_sources(docs, mix, mixing.domain_of_source(F.col("source"))).selectExpr("doc_id", "mix_domain as domain", "lang", "source", "mix_tokens as n_tokens", "mix_epoch as epoch")
    assert sorted(repr(tuple(r)) for r in got.collect()) == rows_of(con, mixing.op7_sql(mix), got.columns)


def test_mixing_edge_cases(spark):
    rows = [(i, "w " * (i % 50), "en" if i % 2 else None, "s1" if i % 3 else None) for i in range(200)] + [(7, "w " * 7, "en", "s1"), (None, "a b", "de", ""), (300, None, "en", "s1"), (301, "w " * 30_000, "fr", "s9")]
    df = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, lang string, source string, budget string")
    out = mixing.mix_sources(df, mixing.Mix(per_mille=500)).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    assert 0 < sum(r.mix_tokens for r in out) <= total // 2
    assert all(r.budget == "d" for r in out)
    clash = df.selectExpr("*", "1 as mix_domain", "2 as mix_tokens", "3 as _d", "4 as _t", "5 as _key", "6 as _cut", "7 as row", "8 as tokens", "9 as epoch", "10 as mix_epoch")
    same = mixing.mixed_documents(clash, mixing.Mix(per_mille=500))
    assert same.columns == clash.columns and {tuple(r)[5:] for r in same.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)}
    assert sorted(str(r.doc_id) for r in same.collect()) == sorted(str(r.doc_id) for r in out)
    assert sorted(str(r.doc_id) for r in mixing.mix_sources(clash, mixing.Mix(per_mille=500)).collect()) == sorted(str(r.doc_id) for r in out)
    none = mixing.mix_sources(df, mixing.Mix(languages={"en": 0}, per_mille=500)).collect()
    assert none and all(r.lang != "en" for r in none)
    assert mixing.mix_sources(df, mixing.Mix(languages={"en": 0, "fr": 0, "de": 0}, default=0)).count() == 0
    assert {r.mix_domain for r in mixing.mix_sources(df.selectExpr("*", "'http://h.example/' || doc_id as url")).collect()} <= {"h.example", None}
    twice = mixing.mix_sources(df, mixing.Mix(per_mille=2000, max_epochs=3)).collect()
    assert max(r.mix_epoch for r in twice) == 2
    assert mixing.mix_sources(df.limit(0)).count() == 0
