"""License scans by canonical digest: whole texts are normalised and looked up among digests of known licences.

Normalising, in this order: lower case; copyright notices dropped (a line that begins with "copyright" or "portions
copyright" and has a year, "(c)" or the sign, or goes on with another word than follows "copyright" in a known text; a
line that begins with the sign, or with "(c)" and has a year; or that is only "all rights reserved"); every run of other
characters than letters a-z and digits made one space; equivalent spellings made equal; in BSD texts the holder's name,
and in GNU texts the FSF's postal address, made equal; trimmed. The digest is the MD5 of what is left. The same Spark
expressions normalise the known texts and the documents.

The known texts are KNOWN, with and without their usual titles, and the files of license_texts/, whole and without
title, preamble or appendix. The SQL of oracle() has KNOWN without titles and an earlier rule for notices (NOTICE); the two
agree on the test tables, which hold no other licence and no such notice.

Defined cases: null or empty text, and text without a-z or digit, have a null digest and match nothing; equal rows
stay; an empty table gives an empty result; columns other than doc_id and text are ignored."""

from __future__ import annotations

import itertools
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: texts of public licences and notices, by SPDX name where there is one
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
}
# fixed values: equivalent spellings, as words before and after
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "noncommercial": "non commercial",
    "organisation": "organization", "copyleft": "copyleft", "favour": "favor", "whilst": "while", "fulfilment": "fulfillment", "judgement": "judgment", "merchantable": "merchantable",
    "cancelled": "canceled", "programme": "program", "utilisation": "utilization", "authorised": "authorized", "recognise": "recognize", "non infringement": "noninfringement", "https": "http",
}
#: The notices as the SQL drops them.
NOTICE = r"(?m)^[^a-z0-9\n]*(?:portions +)?(?:copyright|\(c\)|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
#: Spellings are words of the plain text: a regular expression finds them all in one pass, as far as their change is one rule.
RULES = [(rf" {a} ", f" {b} ") for a, b in SPELLINGS.items() if a != b]

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
FILES = {}
for _name in sorted(os.listdir(HERE)) if os.path.isdir(HERE) else ():  # executors need no texts
    with open(os.path.join(HERE, _name), encoding="utf-8") as _f:
        FILES[_name.removesuffix(".txt")] = _f.read()
#: Words that follow "copyright" in a licence's own sentences: a line may begin there by a wrap.
FOLLOWING = sorted({m[1] for t in (*KNOWN.values(), *FILES.values()) for m in re.finditer(r"copyright[^a-z0-9]+([a-z0-9]+)", t.lower())} - {"c", "yyyy", "year"})
YEAR = r"\b(?:19|20)\d\d\b"
TRUE_NOTICE = (
    rf"(?m)^[^a-z0-9\n]*(?:portions +)?copyright\b(?:[^\n]*(?:\(c\)|©|{YEAR})[^\n]*|[^a-z0-9\n]+(?!(?:{'|'.join(FOLLOWING)})\b)[a-z0-9][^\n]*)$"
    rf"|^[^a-z0-9\n]*\(c\)[^\n]*{YEAR}[^\n]*$|^[^a-z0-9\n]*\(c\) *copyright\b[^\n]*$|^[^a-z0-9\n]*©[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)
#: Parts of plain text that differ between copies of one licence, and a text that all copies with them hold.
BSD_NAME = r" neither the name of .{1,120}? nor the names of (?:its|any) contributors "
GNU_ADDRESS = r" (?:51 franklin st(?:reet)?(?: fifth floor)?|59 temple place(?: suite 330)?|675 mass ave) (?:boston|cambridge) ma 02\d+(?: \d+)?(?: usa)? "
# fixed values: what titles a text, and where a text's parts begin
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "MIT", "License", "(The MIT License)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC", "License", "(The ISC License)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD", "BSD Zero Clause License (0BSD)", "License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD-2-Clause", "BSD License", "License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD-3-Clause", "BSD License", "License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "License"],
    "Unlicense": ["The Unlicense", "Unlicense", "License"],
}
BEGINS = {"CC0-1.0": ["CC0 1.0 Universal", "Statement of Purpose"], "MPL-1.1": ["1. Definitions"], "MPL-2.0": ["1. Definitions"], "LGPL-3.0": ["This version of the GNU Lesser"], "WTFPL": ["TERMS AND CONDITIONS FOR COPYING"]}
ENDS = ["END OF TERMS AND CONDITIONS", "APPENDIX: How", "Appendix: How", "How to Apply These Terms", "EXHIBIT A -", "Exhibit A - Source", "Exhibit B - ", "For more information, please"]


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all forms of the known texts."""
    bodies = [(k, t) for k, t in KNOWN.items()]
    for k, t in FILES.items():
        begins = [0, *(t.index(x) for x in BEGINS.get(k, ()))]
        if k not in BEGINS:
            begins += [t.index(x) for x in ("Preamble", "TERMS AND CONDITIONS") if re.search(rf"(?m)^ *{x}", t)]
        ends = [len(t), *(m.start() for x in ENDS for m in re.finditer(rf"(?m)^ *{x}", t)), *(m.end() for m in re.finditer(r"(?m)^ *END OF TERMS AND CONDITIONS", t))]
        bodies += [(k, t[a:b]) for a, b in itertools.product(begins, ends) if b - a > 60]
        if k == "CC0-1.0":
            bodies.append((k, "CC0 1.0 Universal\n" + t[t.index("Statement of Purpose") :]))
    out = []
    for k, t in bodies:
        forms = {t}
        if k.startswith("BSD"):
            forms |= {x.replace("HOLDER OR CONTRIBUTORS", "OWNER OR CONTRIBUTORS").replace("HOLDER\nOR CONTRIBUTORS", "OWNER OR CONTRIBUTORS") for x in forms}
            forms |= {re.sub("THE\\s+COPYRIGHT\\s+(?:HOLDERS?|OWNER)\\s+(AND|OR)\\s+CONTRIBUTORS", r"THE REGENTS \1 CONTRIBUTORS", x) for x in forms}
            forms |= {re.sub(r"(?m)^\d\. ", "", x) for x in forms}
        if k == "ISC":
            forms.add(t.replace("and/or", "and"))
        out += [(k, f"{title}\n\n{x}") for x in sorted(forms) for title in ("", *TITLES.get(k, ()))]
    return out


def canonical(text: Column) -> Column:
    t = F.lower(text)
    # texts without a notice, nearly all, are spared the slow expression
    t = F.when(t.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(t, TRUE_NOTICE, " ")).otherwise(t)
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(" "))
    for a, b in RULES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.when(t.contains(" neither the name of "), F.regexp_replace(t, BSD_NAME, " neither the name of the copyright holder nor the names of its contributors ")).otherwise(t)
    t = F.when(t.contains(" ma 02"), F.regexp_replace(t, GNU_ADDRESS, " ")).otherwise(t)
    return F.trim(t)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    rows = spark.createDataFrame(sorted(known.items() if known else set(known_texts())), "license string, text string")
    return rows.select("license", F.md5(canonical(F.col("text")).cast("binary")).alias("digest"))


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_canonical (characters of the normalised text), digest and license (null if the text is none).
    The known table is given by the caller and fixed, so it is broadcast; every document is normalised whole."""
    c = F.nullif(canonical(F.col("text")), F.lit(""))
    d = docs.select("doc_id", c.alias("_c")).select("doc_id", F.coalesce(F.length("_c"), F.lit(0)).cast("long").alias("n_canonical"), F.md5(F.col("_c").cast("binary")).alias("digest"))
    return d.join(F.broadcast(known_digests(docs.sparkSession, known).groupBy("digest").agg(F.min("license").alias("license"))), "digest", "left").select("doc_id", "n_canonical", "digest", "license")


def _sql_canonical(x: str) -> str:
    t = f"regexp_replace(lower({x}), '{NOTICE}', ' ', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in RULES:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim({t})"


def oracle() -> str:
    values = ", ".join(f"""('{k}', '{v.replace("'", "''")}')""" for k, v in sorted(KNOWN.items()))
    return f"""
    WITH k AS (SELECT license, md5({_sql_canonical('text')}) AS digest FROM (VALUES {values}) v(license, text)),
    d AS (SELECT doc_id, nullif({_sql_canonical('text')}, '') AS c FROM documents)
    SELECT doc_id, coalesce(length(c), 0)::BIGINT AS n_canonical, md5(c) AS digest, license FROM d LEFT JOIN k ON k.digest = md5(d.c)
    """
