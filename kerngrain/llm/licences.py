"""Licence texts and notices by canonical digest, in DataFrame functions alone.

A text is made canonical: lower case; lines that state a copyright (the word or sign with a year, a sign or a
placeholder) go; every run of characters other than letters and digits becomes one space; spellings that licence texts use
alike become one. Its SHA-256 is looked up among the digests of known texts, made the same way, by a hash join.
The units looked up are each whole text and each of its lines, so that a notice on a line of its own counts too.

Every known text holds one of MARKERS as a part of one word, which no step can make out of anything else; a unit without
one is skipped before the regular expressions. The known texts are a fixed table, which is what is broadcast: KNOWN, the
notices that say "or any later version", and the entire licences in ``licence_texts``. A table of other texts may be
given instead; it is joined as Spark sees fit, and no unit is skipped then. The SQL knows KNOWN alone.

Edge cases: null or empty texts and units without a letter or digit match nothing. Rows that repeat a doc_id get what all of
them hold, once each; null doc_ids count as one id. Very long texts are used whole. No rows: no rows. Further columns
are not looked at.
"""

from __future__ import annotations

import importlib.resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3RD = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Licence identifiers and the public texts and notices that state them.
KNOWN = (
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3RD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3RD + _BSD_END),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Licences by name and version, and their identifiers; a text alone doesn't say whether later versions may be taken.
FULL = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_LATER = (("GPL", "2", "2.0"), ("GPL", "3", "3.0"), ("LGPL", "2.1", "2.1"), ("LGPL", "3", "3.0"), ("AGPL", "3", "3.0"))
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
#: Spellings that licence texts use alike.
ALIKE = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("share alike", "sharealike"),
    ("copyright owner", "copyright holder"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("redistributions", "redistribution"),
    ("https ", "http "),
    ("whilst", "while"),
)
MARKERS = ("licen", "redistribution", "permission")
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[yyyy\]|\[year\])|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
BETWEEN = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit("\n"))
    out = F.trim(F.regexp_replace(out, F.lit(BETWEEN), F.lit(" ")))
    for a, b in ALIKE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def later_notices() -> list[tuple[str, str]]:
    """The notices of the GNU licences that allow later versions: the grant alone, and with what follows it."""
    out = []
    for short, version, number in _LATER:
        name, of = _GNU[short], f"{short}-{number}-or-later"
        for what in ("program", "library", "file", "software"):
            for colon in ("", ":"):
                grant = f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{colon and ','} either version {version} of the License, or (at your option) any later version."
                warranty = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
                end = f"You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
                out += [(of, grant), (of, f"{grant}\n\n{warranty}"), (of, f"{grant}\n\n{warranty}\n\n{end}")]
        out += [(of, f"Licensed under the {name}, version {version} or later."), (of, f"SPDX-License-Identifier: {of}")]
    return out


def full_texts() -> list[tuple[str, str]]:
    """Entire licences; those with an appendix on how to apply them also without it."""
    out = [("Unlicense", _UNLICENSE)]
    for name, licence in FULL.items():
        text = (importlib.resources.files(__package__) / "licence_texts" / f"{name}.txt").read_text("utf-8")
        out.append((licence, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(licence, terms), (licence, terms + end)]
    return out


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence): a row for each of KNOWN, the notices of later versions and the entire licences."""
    return digests_of(spark.createDataFrame([*KNOWN, *later_notices(), *full_texts()], "licence string, text string"))


def digests_of(known: DataFrame) -> DataFrame:
    """known: licence, text."""
    canon = canonical(F.col("text").cast("string"))
    return known.select(F.col("licence").cast("string").alias("licence"), canon.alias("canon")).where("canon <> ''").select(F.sha2("canon", 256).alias("digest"), "licence").distinct()


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs with doc_id and text to (doc_id, licences, whole_text_licence, n_units), a row for each row.

    known: licence and text of the known texts, instead of the fixed table.
    """
    marked = lambda x: F.contains(x, F.lit(MARKERS[0])) | F.contains(x, F.lit(MARKERS[1])) | F.contains(x, F.lit(MARKERS[2])) if known is None else F.isnotnull(x)
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(marked(F.lower("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: marked(F.lower(x)))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))
    digests = some.select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.whole", F.sha2(canonical(F.col("x.unit")), 256).alias("digest"))
    # the fixed table is small
    found = digests.join(F.broadcast(known_digests(docs.sparkSession)) if known is None else digests_of(known), "digest")
    each = found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),  # the known texts bound the set
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("whole_text_licence"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_lines"),
    )
    return docs.select("doc_id").alias("d").join(each.alias("e"), F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")), "left").select("d.doc_id", "licences", "whole_text_licence", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def _sql_canonical(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, chr(10), 'g')"
    out = f"trim(regexp_replace({out}, {quoted(BETWEEN)}, ' ', 'g'))"
    for a, b in ALIKE:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return out


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT licence, sha256({_sql_canonical("text")}) AS digest FROM (VALUES {values}) AS k(licence, text)),
units AS (SELECT doc_id, true AS whole, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents),
found AS (SELECT doc_id, whole, licence FROM (SELECT doc_id, whole, sha256({_sql_canonical("unit")}) AS digest FROM units) u JOIN known USING (digest)),
each AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences, max(CASE WHEN whole THEN licence END) AS whole_text_licence,
  count(*) FILTER (WHERE NOT whole) AS n_lines FROM found GROUP BY doc_id)
SELECT d.doc_id, licences, whole_text_licence, coalesce(n_lines, 0) AS n_lines FROM documents d LEFT JOIN each ON d.doc_id IS NOT DISTINCT FROM each.doc_id
"""
