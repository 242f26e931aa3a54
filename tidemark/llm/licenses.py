"""Operator 4: licence texts found by the digest of their canonical form.

Texts are normalised (case, punctuation, copyright lines, equivalent spellings) and the
digest of the whole is joined with the digests of known licences.  The same digest is
looked up for each line, which finds notices such as "Released under the MIT License."
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut

# Spellings that mean the same (after lower-casing and without punctuation).
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("grey", "gray"), ("honour", "honor"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("programme", "program"),
    ("recognise", "recognize"), ("redistribute and", "redistribution and"), ("https", "http"), ("copyright holder s", "copyright holders"),
    ("non infringement", "noninfringement"), ("per cent", "percent"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
)

# Texts of known licences and common notices (SPDX identifier, kind, text).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", "permissive", _MIT), ("MIT", "permissive", "MIT License\n" + _MIT), ("MIT", "permissive", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "permissive", _ISC), ("ISC", "permissive", "ISC License\n" + _ISC),
    ("BSD-2-Clause", "permissive", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "permissive", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "permissive", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL), ("BSD-3-Clause", "permissive", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("Zlib", "permissive", _ZLIB), ("Zlib", "permissive", "zlib License\n" + _ZLIB), ("Apache-2.0", "permissive", _APACHE_NOTICE),
    ("MIT", "permissive", "Released under the MIT License."), ("MIT", "permissive", "Licensed under the MIT License."), ("MIT", "permissive", "MIT License"),
    ("MIT", "permissive", "This project is licensed under the MIT License."), ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "permissive", "Apache License, Version 2.0"),
    ("GPL-3.0-only", "copyleft", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "copyleft", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "copyleft", "Released under the GNU General Public License, version 3."), ("GPL-2.0-only", "copyleft", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "restricted", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "permissive", "Licensed under CC0 1.0."),
    ("LicenseRef-All-Rights-Reserved", "restricted", "All rights reserved."),
)

# Canonical digests of whole licence texts (SPDX identifier, kind, digest), as
# Debian's common-licenses have them; the second of a licence is the text up to "END OF TERMS
# AND CONDITIONS", without the advice on how to apply it.
DIGESTS = (
    ("Apache-2.0", "permissive", "4f8caa9a32c00fbc0b82aa9c4bec85c3"), ("Apache-2.0", "permissive", "28ebc01248a8dee857c26cb670d23345"),
    ("Artistic-1.0-Perl", "permissive", "a8b0fb0c6e43a3b36bdc159e59dbfd1e"), ("CC0-1.0", "permissive", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2-only", "copyleft", "7a0a547ecac612b526676be523eacf80"), ("GFDL-1.3-only", "copyleft", "7132e8380bc59358f27c3129a2136bf1"),
    ("GPL-1.0-only", "copyleft", "31809d5ff1b729b7f878bc75c418d30f"), ("GPL-1.0-only", "copyleft", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-2.0-only", "copyleft", "af75a5e661f550f67c9548e7dd4ba8e7"), ("GPL-2.0-only", "copyleft", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-3.0-only", "copyleft", "357ae433fb51614743c19a61d3021ca3"), ("GPL-3.0-only", "copyleft", "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0-only", "copyleft", "de345374dd8e314aed49ab961737c454"), ("LGPL-2.0-only", "copyleft", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.1-only", "copyleft", "6f409198495a67ac04df260ee6e879e6"), ("LGPL-2.1-only", "copyleft", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-3.0-only", "copyleft", "b31b7335bc37919e8cdd79154e04d88d"), ("MPL-1.1", "copyleft", "a708f02208e9c42d3644490185833425"),
    ("MPL-2.0", "copyleft", "35fb4d2625087f7fd780039aa7b4ebb2"),
)

# Lines that begin with a notice that names a holder or a year are left out; a line of a text
# that was wrapped before the word "copyright" stays.
_COPYRIGHT_LINE = r"(?m)^[\t ]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|[\[<])|\(c\)|©)[^\n]*(?:\n|$)"
_OTHER = r"[^\p{L}\p{N}]+"
LITERAL_ROWS = 256


def canonical(text: Column) -> Column:
    """The form in which texts of one licence agree: lower case without copyright lines,
    words parted by single spaces and spelled one way."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, _OTHER, " ")), F.lit(" "))
    for spelling, common in EQUIVALENT:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {common} "))
    return F.trim(out)


def known_licenses(spark: SparkSession) -> DataFrame:
    """digest, license, kind of the licences above (one row per digest)."""
    rows = [F.struct(F.lit(a).alias("license"), F.lit(b).alias("kind"), F.lit(c).alias("text")) for a, b, c in KNOWN]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    whole = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("digest"), F.lit(a).alias("license"), F.lit(b).alias("kind")) for a, b, c in DIGESTS])))
    known = table.select(F.md5(canonical(F.col("text"))).alias("digest"), "license", "kind").unionByName(whole)
    return known.groupBy("digest").agg(F.min("license").alias("license"), F.min("kind").alias("kind"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license, kind, notices of every document.

    ``license`` and ``kind`` are those whose canonical digest equals that of the whole
    text, else null.  ``notices`` names the licences whose digest equals that of a line,
    in order and without repeats, parted by commas ('' if none).

    ``known`` has (digest, license, kind), one row per digest.  Up to LITERAL_ROWS rows
    (counted first) lines are looked up in place; beyond, lines are joined on the digest
    like whole texts and what hits comes back to its row.  Very long texts are read whole.  Null or empty text: the digest of '', no licence.  Null
    or repeated doc_id: each row is answered on its own.  Empty table: no rows.
    """
    known = known_licenses(docs.sparkSession) if known is None else known.select("digest", "license", "kind")
    few = known.limit(LITERAL_ROWS + 1).collect()
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = read.withColumn("digest", F.md5(canonical(F.col("text"))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    digests = F.transform(lines, lambda x: F.md5(canonical(x)))
    known = known.select(F.col("digest").alias("__digest"), "license", "kind")
    if 0 < len(few) <= LITERAL_ROWS:
        names = F.map_from_arrays(F.lit([r["digest"] for r in few]), F.lit([r["license"] for r in few]))
        found = F.filter(F.transform(digests, lambda d: F.try_element_at(names, d)), lambda x: x.isNotNull())
        read = read.withColumn("notices", F.array_join(F.array_sort(F.array_distinct(found)), ","))
        return read.join(F.broadcast(known), F.col("digest") == F.col("__digest"), "left").select("doc_id", "digest", "license", "kind", "notices")
    # The row's place stands for the row while its lines are joined; it is written down
    # first, since a place that is computed twice need not come out the same.
    read = cut(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", digests.alias("digests")))
    hits = read.select("row", F.explode("digests").alias("__digest")).join(known, "__digest")
    hits = hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = read.join(known, F.col("digest") == F.col("__digest"), "left")
    return whole.join(hits, "row", "left").select("doc_id", "digest", "license", "kind", F.coalesce("notices", F.lit("")).alias("notices"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_licenses`` of all documents with the licences known here."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_COPYRIGHT_LINE}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{_OTHER}', ' ', 'g'), ' ') || ' '"
    for spelling, common in EQUIVALENT:
        out = f"replace({out}, ' {spelling} ', ' {common} ')"
    return f"trim({out}, ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP4_SQL = f"""
WITH given (license, kind, text) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in KNOWN)}
), digests (license, kind, digest) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in DIGESTS)}
), known AS (
  SELECT digest, min(license) AS license, min(kind) AS kind
  FROM (SELECT md5({_sql_canonical("text")}) AS digest, license, kind FROM given UNION ALL SELECT digest, license, kind FROM digests) GROUP BY 1
), doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM doc
), hit AS (
  SELECT r, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT r, license FROM line JOIN known ON md5({_sql_canonical("line")}) = digest WHERE trim(line, ' ') <> '') GROUP BY r
)
SELECT doc_id, md5({_sql_canonical("doc.text")}) AS digest, license, kind, coalesce(notices, '') AS notices
FROM doc LEFT JOIN known ON md5({_sql_canonical("doc.text")}) = known.digest LEFT JOIN hit USING (r)
"""
