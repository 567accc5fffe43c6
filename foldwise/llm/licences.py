"""Licence scan: whole texts and lines looked up by canonical digest.

A text is normalised (lower case; copyright lines out; equivalent spellings made
one; punctuation and bullets as single spaces) and digested. Digests of whole
texts and of single lines are hash-joined to the digests of known licence texts
and notices, made by the same expression. DataFrame functions only. The known
table ``KNOWN`` has a fixed number of rows, so its broadcast is bounded; a caller
may pass a table of any size in its place.

Rows: null or empty text has no licence. Results are per row, so null and
repeated ids and repeated rows keep their rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hinted, plain_text, stored

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("noninfringement", "non-infringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("http://", "https://"),
    ("&", " and "),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

# Entire texts in licence_texts, with the line that ends the terms where an appendix follows it.
_ENTIRE = {
    "Apache-2.0": "END OF TERMS AND CONDITIONS",
    "GPL-2.0": "END OF TERMS AND CONDITIONS",
    "GPL-3.0": "END OF TERMS AND CONDITIONS",
    "LGPL-2.1": "END OF TERMS AND CONDITIONS",
    "LGPL-3.0": None,
    "MPL-2.0": None,
    "CC0-1.0": None,
}


def _entire() -> list[tuple[str, str]]:
    """Entire texts, with and without the appendix after the terms."""
    out = []
    for name, end in _ENTIRE.items():
        text = pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode("ascii")
        out.append((name, text))
        if end:
            terms = text[: text.index(end)]
            out += [(name, terms), (name, terms + end)]
    return out


# Parts of one-line notices.
_UNDER = ["Licensed under", "Released under", "This work is licensed under", "This project is licensed under"]
_NAMED = {
    "MIT": ["the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "Zlib": ["the zlib License"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "a CC0 1.0 license"],
}
_GNU = {
    "GPL": ("General", ("2", "3")),
    "LGPL": ("Lesser General", ("2.1", "3")),
    "AGPL": ("Affero General", ("3",)),
}
_CC_PARTS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
_CC_AREA = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}


def _notices() -> list[tuple[str, str]]:
    """One-line notices: every verb with every name of every version."""
    named = [(licence, name) for licence, names in _NAMED.items() for name in names]
    for short, (kind, versions) in _GNU.items():
        for v in versions:
            licence = f"{short}-{v if '.' in v else v + '.0'}"
            for said in dict.fromkeys((v, licence.removeprefix(f"{short}-"))):
                named += [(licence, f"the GNU {kind} Public License, version {said}"), (licence, f"the GNU {kind} Public License v{said}"), (licence, f"the GNU {short} v{said}")]
    out = []
    for parts in _CC_PARTS:
        for v, area in _CC_AREA.items():
            licence = f"CC-{parts}-{v}"
            words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives" if v == "4.0" else "NoDerivs"}
            name = "-".join(words[x] for x in parts.split("-"))
            named += [(licence, f"CC {parts} {v}"), (licence, f"a CC {parts} {v} License"), (licence, f"the CC {parts} {v} License")]
            url = f"https://creativecommons.org/licenses/{parts.lower()}/{v}/"
            for article in ("", "a ", "the "):
                for full in (f"{article}Creative Commons {name} {v} License", f"{article}Creative Commons {name} {v} {area} License"):
                    named.append((licence, full))
                    line = f"This work is licensed under {full}. To view a copy of this license, visit {url}"
                    out += [(licence, line), (licence, line + " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")]
    return [(licence, f"{under} {name}.") for licence, name in named for under in _UNDER] + out


# Licence texts and one-line notices in general use.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under a CC0 1.0 license."),
    *_entire(),
    *_notices(),
]

#: Every known text has one of these; others need no digest.
MARK = r"(?i)licen[cs]e|released|redistribution|permission"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n(]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = "[^a-z0-9]+"


def normalised(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, NOT_WORD, " "))


def known_digests(texts: DataFrame) -> DataFrame:
    """``(digest, licence)`` of ``texts(licence, text)``."""
    rows = texts.select("licence", normalised(F.col("text").cast("string")).alias("t")).where("licence is not null and t <> ''")
    return rows.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: licence of the whole text, number of licence lines, all licences found.

    ``known(licence, text)`` replaces ``KNOWN``; as its texts need not hold a mark, every line is then digested.
    """
    text = plain_text(F.col("text").cast("string"))
    digest = lambda t: F.sha2(normalised(t), 256)
    has_mark = (lambda t: t.rlike(MARK)) if known is None else (lambda t: F.lit(True))
    lines = F.transform(F.filter(F.split(text, "\n"), has_mark), digest)
    marked = has_mark(text)
    if known is None:
        table = F.broadcast(known_digests(docs.sparkSession.createDataFrame(KNOWN, "licence string, text string")))
    else:
        table = hinted(stored(known_digests(known), "known"), 100_000)
    slim = docs.select("doc_id", F.when(marked, digest(text)).alias("whole"), F.when(marked, lines).alias("lines"), F.monotonically_increasing_id().alias("_row"))
    slim = stored(slim, "digests")
    unit = lambda d, whole: F.struct(d.alias("digest"), F.lit(whole).alias("is_whole"))
    units = F.concat(F.array(unit(F.col("whole"), True)), F.transform("lines", lambda d: unit(d, False)))
    found = slim.where("whole is not null").select("_row", F.explode(units).alias("u")).select("_row", "u.digest", "u.is_whole")
    hits = found.join(table, "digest")
    sums = hits.groupBy("_row").agg(
        F.max(F.when(F.col("is_whole"), F.col("licence"))).alias("whole_licence"),
        F.sum((~F.col("is_whole")).cast("long")).alias("n_lines"),
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("names"),
    )
    return slim.select("doc_id", "_row").join(sums, "_row", "left").select(
        "doc_id", "whole_licence", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_licence_lines"), F.coalesce("names", F.lit("")).alias("licences")
    )


def plain_normalised(text: str) -> str:
    """The same normal form for ASCII text, in plain Python: the check's side of the digests."""
    t = re.sub(COPYRIGHT_LINE, " ", text.lower())
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub(NOT_WORD, " ", t).strip(" ")


def _oracle() -> str:
    known = {hashlib.sha256(plain_normalised(t).encode()).hexdigest(): n for n, t in reversed(KNOWN)}
    values = ", ".join(f"('{d}', '{n}')" for d, n in known.items())
    t = f"regexp_replace(lower(t), '{COPYRIGHT_LINE}', ' ', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    digest = f"sha256(trim(regexp_replace({t}, '{NOT_WORD}', ' ', 'g')))"
    return f"""
WITH known(digest, licence) AS (VALUES {values}),
numbered AS (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT rowid AS r, TRUE AS is_whole, text AS t FROM numbered
  UNION ALL SELECT rowid, FALSE, unnest(string_split(text, chr(10))) FROM numbered
), hits AS (SELECT r, is_whole, licence FROM units JOIN known ON known.digest = {digest}
), sums AS (
  SELECT r, max(CASE WHEN is_whole THEN licence END) AS whole_licence, sum(CASE WHEN is_whole THEN 0 ELSE 1 END) AS n, array_to_string(list_sort(list(DISTINCT licence)), ',') AS names
  FROM hits GROUP BY r
)
SELECT doc_id, whole_licence, CAST(coalesce(n, 0) AS BIGINT) AS n_licence_lines, coalesce(names, '') AS licences
FROM numbered LEFT JOIN sums ON r = rowid
"""


ORACLE = _oracle()
