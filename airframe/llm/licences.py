"""Licence scan by digests of canonical texts, in DataFrame and SQL functions only.

A text is made canonical (case, copyright lines, punctuation, white space, equivalent spellings) and its SHA-256 is
joined with the digests of known licences. Whole documents are looked up, and whole lines, so that a notice in
a longer document is found too; parts of a line are not searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe.llm.common import pick, query, table

#: Lines that name a holder or a year, which differ from copy to copy. A line with a sign or a year is such
#: a line wherever it stands; others only where they begin or end a paragraph and go on with none of the words that
#: follow in a licence's own sentence. No pattern repeats a group without a bound, so that no line is too long for it.
GOES_ON = "(?:and|as|disclaimers?|holders?|in|interests?|laws?|licen[cs]es?|notices?|of|or|owners?|permissions?|protection|rights?|statements?|to|treat(?:y|ies))"
BLANK = r"^[ \t\r]*\z"
SIGNED = r"^[ \t]*(?:(?:copyright|\(c\))[ \t,:]*(?:\(c\)|©|copyright|[0-9]{4})|©|all rights reserved[^\p{L}\p{N}]*\z)"
NAMED = r"^[ \t]*copyright[ \t:]+[\p{L}\p{N}<\[]"
SENTENCE = rf"^[ \t]*copyright[ \t:]+{GOES_ON}(?:[^\p{{L}}\p{{N}}_]|\z)"
ALONE = r"^[ \t]*\(c\)(?:[ \t]+[^ \t\r\x0B\f]+){0,7}[ \t]+[^ \t\r\x0B\f]*[^ \t\r\x0B\f;,:][ \t\r]*\z"
HINTS = ("copyright", "(c)", "©", "all rights reserved")
#: Spellings that count as equal, applied in this order to the words of a text.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"),
    ("https", "http"),
    ("v2", "version 2"),
    ("v3", "version 3"),
]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""

#: Identifier and text of known licences and of the notices that stand for them.
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: Digests of the canonical form of long licence texts, whole and as published, with their appendices.
DIGESTS = {
    "Apache-2.0": "d5b6708487fbbbf89cc5abdd972838249d3265d5241105b6bacda1706c4068e6",
    "CC0-1.0": "3e6e368fd02abd67188d1bf25b196ac79f5782b2079e9579134c5e3f71f9ab74",
    "GPL-1.0": "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef",
    "GPL-2.0": "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61",
    "GPL-3.0": "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63",
    "LGPL-2.0": "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24",
    "LGPL-2.1": "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b",
    "LGPL-3.0": "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938",
    "MPL-1.1": "724757714a8157908a4262d37330f3ac617800181f14c5bb7ae1773611ef1af5",
    "MPL-2.0": "7eb42cd7f8edde0699d303a531b8d604a4370bd579346f5e1d615398ffe83791",
    "Artistic-1.0": "ab9e0a4960f3366c6e09c86510fe9dd469d242185a905b440792fcc4a45b46ef",
}

#: Letters of lines: a named line after a blank one, or after another that goes for that; a named line before a blank one; a
#: line alone between blank ones.
RUNS = (r"(?:(?<![^_S])|\G)N", r"N(?=[_SX]|\z)", r"(?<![^_SX])A(?=[_SX]|\z)")


def without_holders(low: Column) -> Column:
    """A lower-case text whose lines that name a holder are blank.

    Each line becomes one letter: blank (``_``), signed (``S``), named (``N``), alone (``A``) or other (``o``). The letters
    of all lines are one string, in which neighbours decide, so the cost grows with the text and nothing else.
    """

    def letter(x: Column) -> Column:
        named = x.rlike(NAMED) & ~x.rlike(SENTENCE)
        return F.when(x.rlike(BLANK), "_").when(x.rlike(SIGNED), "S").when(named, "N").when(x.rlike(ALONE), "A").otherwise("o")

    def kept(lines: Column) -> Column:
        letters = F.array_join(F.transform(lines, letter), "")
        for run in RUNS:
            letters = F.regexp_replace(letters, run, "X")
        return once(F.split(letters, "", -1), lambda k: F.array_join(F.transform(lines, lambda x, i: F.when(k[i].isin("S", "X"), " ").otherwise(x)), "\n"))

    return F.when(reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in HINTS]), once(F.split(low, "\n", -1), kept)).otherwise(low)


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def canonical(text: Column) -> Column:
    """Canonical form of a text: words of letters and digits with one blank between them, a blank at both ends."""
    c = F.regexp_replace(once(F.lower(text), without_holders), "[^\\p{L}\\p{N}]+", " ")
    c = F.concat(F.lit(" "), F.trim(c), F.lit(" "))
    for other, usual in SPELLINGS:
        c = F.replace(c, F.lit(f" {other} "), F.lit(f" {usual} "))
    return c


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``(digest, licence)`` of known texts: the built-in ones, a list, or a frame with ``licence`` and ``text``."""
    built_in = texts is None
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(KNOWN if built_in else texts, "licence string, text string")
    rows = pick(texts, licence="licence", text="text").where("text IS NOT NULL").select(digest(F.col("text")).alias("digest"), "licence")
    if built_in:
        rows = rows.union(spark.createDataFrame(list(DIGESTS.items()), "licence string, digest string").select("digest", "licence"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, licence, notices)`` per row: the licence whose text the whole document is, and the sorted
    licences whose text a whole line is.

    A NULL text has the digest of the empty one. Texts without letters or digits match no licence, unless a known
    text has none either. Where one digest is known under several names the first one counts. Repeated rows
    get equal answers; an empty table gives no rows. Texts stay where they are: lines become digests in
    the scan, only those that are known are brought together by document.
    """
    rows = pick(docs, doc_id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    mark = ["row", "twin"]
    rows = rows.withColumns({"row": F.xxhash64("doc_id", "text"), "twin": F.xxhash64(F.lit(1), "text", "doc_id")})
    lines = rows.select(*mark, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.select(*mark, digest(F.col("line")).alias("digest"))
    notices = lines.join(known, "digest").groupBy(*mark).agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    whole = rows.select("doc_id", *mark, digest(F.col("text")).alias("digest"))
    found = whole.join(known, "digest", "left").join(notices, mark, "left")
    return found.select("doc_id", "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def _sql_canonical(text: str) -> str:
    """Canonical form of a lower-case text without holder lines."""
    c = f"(' ' || trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"
    for other, usual in SPELLINGS:
        c = f"replace({c}, ' {other} ', ' {usual} ')"
    return c


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_letter(line: str) -> str:
    blank, signed, named, sentence, alone = (_quoted(p.replace(r"\x0B", "\x0b")) for p in (BLANK, SIGNED, NAMED, SENTENCE, ALONE))
    return f"""CASE WHEN regexp_matches({line}, {blank}) THEN '_' WHEN regexp_matches({line}, {signed}) THEN 'S'
      WHEN regexp_matches({line}, {named}) AND NOT regexp_matches({line}, {sentence}) THEN 'N' WHEN regexp_matches({line}, {alone}) THEN 'A' ELSE 'o' END"""


#: The rule on lines by window functions: the line before a run of named ones, and the letters next to a line.
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, * FROM (
    SELECT 'known' AS kind, NULL AS doc_id, licence, lower(t) AS text FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(t)})' for a, t in KNOWN)}) AS v(licence, t)
    UNION ALL SELECT 'document', doc_id, NULL, lower(coalesce(text, '')) FROM documents)),
l AS (SELECT r, kind, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
k AS (SELECT *, {_sql_letter('line')} AS k FROM l),
g AS (SELECT *, sum(CASE WHEN k <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run, lead(k, 1, '_') OVER (PARTITION BY r ORDER BY i) AS next FROM k),
n AS (SELECT *, CASE WHEN k = 'N' AND (run = 0 OR max(CASE WHEN k <> 'N' THEN k END) OVER (PARTITION BY r, run) IN ('_', 'S')) OR (k = 'N' AND next IN ('_', 'S')) THEN 'X' ELSE k END AS x FROM g),
a AS (SELECT *, CASE WHEN x = 'A' AND lag(x, 1, '_') OVER w IN ('_', 'S', 'X') AND lead(x, 1, '_') OVER w IN ('_', 'S', 'X') THEN 'X' ELSE x END AS z FROM n WINDOW w AS (PARTITION BY r ORDER BY i)),
w AS (SELECT r, sha256({_sql_canonical("string_agg(CASE WHEN z IN ('S', 'X') THEN ' ' ELSE line END, chr(10) ORDER BY i)")}) AS digest FROM a GROUP BY r),
known AS (SELECT digest, min(licence) AS licence FROM (SELECT digest, licence FROM w JOIN t USING (r) WHERE kind = 'known'
    UNION ALL SELECT digest, licence FROM (VALUES {', '.join(f"('{d}', '{n}')" for n, d in DIGESTS.items())}) AS v(digest, licence)) GROUP BY digest),
one AS (SELECT DISTINCT doc_id, CASE WHEN k IN ('S', 'N', 'A') THEN ' ' ELSE line END AS line FROM k WHERE kind = 'document'),
m AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM one) JOIN known USING (digest) GROUP BY doc_id)
SELECT t.doc_id, w.digest, known.licence, coalesce(notices, '') AS notices FROM t JOIN w USING (r) LEFT JOIN known ON known.digest = w.digest LEFT JOIN m ON m.doc_id IS NOT DISTINCT FROM t.doc_id WHERE kind = 'document'
"""


@query("op4_licences", SQL)
def op4_licences(spark, sf):
    found = scan(table(spark, sf, "documents"), known_digests(spark))
    return found.withColumn("notices", F.array_join("notices", ","))
