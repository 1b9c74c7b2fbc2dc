"""Licence scans by canonical digests: texts are brought to one form (case, copyright lines, punctuation, white space,
equivalent spellings) and the digest of the whole form is joined to the digests of known licences. The lines of a
text are looked up in the same way, for notices; only lines as long as a known form are hashed. Built-in functions only.

Known: the texts and digests of this module (see LICENSES and DIGESTS), or a table that the caller gives.

Scale: one scan. Known digests, up to MAX_KNOWN, are sent to each executor; beyond that they are joined by a shuffle of digests. No
text is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, settle

#: Spellings that the matching guidelines of licence lists hold to be the same.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("centre", "center"), ("colour", "color"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("licence", "license"), ("merchantability", "merchantibility"), ("modelled", "modeled"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organised", "organized"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("recognised", "recognized"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("http ", "https "),
)
#: A line that begins so, after anything but letters, is a copyright line.
COPYRIGHT = r"(^|\n)[^\p{L}\n]*(copyright [^\n]*[0-9][^\n]*|\(c\) [^\n]*(19|20)[0-9]{2}[^\n]*|©[^\n]*|all rights reserved[. ]*)(?=\n|$)"
NOT_WORDS = r"[^\p{L}\p{N}\n]+"

#: Texts of known licences, without their copyright lines.
PERMISSIVE_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
AUTHOR_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE. For more information, please refer to "
)
BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a "
    'copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
    "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
    "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE "
    "SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
LICENSES = (
    ("MIT", MIT_GRANT + PERMISSIVE_WARRANTY),
    ("BSD-2-Clause", BSD_GRANT + BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License " + BSD_GRANT + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_GRANT + BSD_THIRD + BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License " + BSD_GRANT + BSD_THIRD + BSD_WARRANTY),
    ("Unlicense", UNLICENSE + "<https://unlicense.org>"),
    ("Unlicense", UNLICENSE + "<https://unlicense.org/>"),
    ("BSL-1.0", BOOST),
    ("MIT", "MIT License " + MIT_GRANT + PERMISSIVE_WARRANTY),
    ("MIT", "The MIT License (MIT) " + MIT_GRANT + PERMISSIVE_WARRANTY),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + AUTHOR_WARRANTY),
    ("ISC", "ISC License " + ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + AUTHOR_WARRANTY),
    ("0BSD", ISC_GRANT + ". " + AUTHOR_WARRANTY),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


#: Digests of the canonical forms of long licences (as Debian ships their texts), and the forms' lengths.
DIGESTS = (
    ("Apache-2.0", "398c9c6f365bd9f4474d17ce6b55be72e7e733bce023e177a3cc754d310b6931", 9923),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
    ("BSD-3-Clause", "f69e9b33798f1fe369f68c9e9357359308512eeab9f7df9005585c792f97f2dc", 1417),
    ("CC0-1.0", "ac97115d8ff546509c6b9c2a58fe5a39b405a801175f5e4193ab8c010d239860", 6622),
    ("GFDL-1.2", "3266875239f14c42c303e6d07b686d40efd77c403c3e6d4d73bfe9f270a34853", 19608),
    ("GFDL-1.3", "84f31744ca5444c4b5bab9f7efea8a299a1be841159cd8e9d4ac9a1e5e24a179", 21977),
    ("GPL-1.0", "7e8826cb5cff28018133ad9c57fb6ebff8382069747b2a01747d6248db85b165", 11764),
    ("GPL-2.0", "800061e253b01d88b2de9331ae421c4a86492edf6a5ea5f3738e797655d6b9a0", 17148),
    ("GPL-3.0", "829917c84861b2a6987f6dc88566617543b6c5995db097ed92c1b64d4fc829bd", 33373),
    ("LGPL-2.0", "b679447ee5faf0307bc3e5c28f7f4dab7da2fe218a9aa4f6780591609ba54da8", 24160),
    ("LGPL-2.1", "81969e65387bee00b6634bec966e9c9b7841eda0dc757b6d55a4ee5d39653b1f", 25247),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986", 22448),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13", 14342),
)
#: Most known digests that are sent to each executor; more are joined by a shuffle.
MAX_KNOWN = 10_000


def canonical_lines(text: Column) -> Column:
    """The form with its lines kept; null is empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1")
    out = F.regexp_replace(out, NOT_WORDS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def whole_form(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license, chars) of the known texts, one row per digest; chars is the length of the form, as notices are looked up."""
    rows = spark.createDataFrame(list(LICENSES), "license string, text string") if texts is None else texts.where("license is not null").select("license", "text")
    form = whole_form(canonical_lines(F.col("text")))
    rows = rows.select(digest(form).alias("digest"), "license", F.length(form).cast("bigint").alias("chars"))
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame([(d, n, c) for n, d, c in DIGESTS], "digest string, license string, chars bigint"))
    return rows.where("chars > 0").groupBy("digest").agg(F.min("license").alias("license"), F.min("chars").alias("chars"))


def scanned(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", texts: DataFrame | None = None) -> DataFrame:
    """Per row: id, digest of the whole canonical text, license (null where it is none that is known), n_notices
    (lines that are known notices or licences), notices (their distinct licences, sorted, with commas; null where
    none). texts (license, text): known texts instead of this module's, any number of them. Null and empty texts have the digest
    of the empty form, which is no licence's. Very long texts take time and memory in proportion; rows are scanned one by one,
    also where ids are null or repeat; an empty table gives an empty table; other columns are not read."""
    every = known(spark, texts)
    rows = every.limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        return _joined(spark, docs, id_col, settle(spark, every, "known"))
    table = spark.createDataFrame([(r["digest"], r["license"]) for r in rows], "digest string, license string")
    by_digest = F.create_map(*(F.lit(x) for r in rows for x in (r["digest"], r["license"]))) if rows else F.create_map().cast("map<string,string>")
    lengths = sorted({r["chars"] for r in rows})
    lines, all_, found = (fresh(n, [id_col]) for n in ("lines", "all", "found"))
    ready = docs.select(F.col(id_col), canonical_lines(F.col("text")).alias(lines)).select(id_col, digest(whole_form(F.col(lines))).alias("digest"), F.split(lines, "\n").alias(all_))
    some = F.filter(F.transform(all_, lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths))
    hits = F.filter(F.transform(some, lambda x: F.try_element_at(by_digest, digest(x))), lambda x: x.isNotNull())
    out = ready.join(F.broadcast(table), "digest", "left").select(id_col, "digest", "license", hits.alias(found))
    return out.select(id_col, "digest", "license", F.size(found).cast("bigint").alias("n_notices"), F.when(F.size(found) > 0, F.array_join(F.array_sort(F.array_distinct(found)), ",")).alias("notices"))


def _joined(spark: SparkSession, docs: DataFrame, id_col: str, every: DataFrame) -> DataFrame:
    """scanned() against any number of known digests: the digests of whole texts, and of the lines that are as long as a known form, meet
    them in joins by digest. Forms are computed once and written without their texts."""
    lines, row = fresh("lines", [id_col]), fresh("row", [id_col])
    lengths = every.agg(F.collect_set("chars").alias("_lengths"))  # one row: the different lengths of known forms
    ready = docs.select(F.col(id_col), canonical_lines(F.col("text")).alias(lines)).join(F.broadcast(lengths))
    some = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: F.array_contains("_lengths", F.length(x).cast("bigint")))
    ready = ready.select(id_col, digest(whole_form(F.col(lines))).alias("digest"), F.transform(some, digest).alias("_some"))
    ready = settle(spark, ready.withColumn(row, F.monotonically_increasing_id()), "forms")
    names = every.select("digest", "license")
    hits = ready.select(row, F.explode("_some").alias("digest")).join(names, "digest").groupBy(row)
    hits = hits.agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = ready.join(names, "digest", "left").join(hits, row, "left")
    return out.select(id_col, "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), "notices")


def oracle_sql() -> str:
    """The same, for DuckDB."""

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        # RE2 has no look-ahead: the end of a copyright line is captured and put back.
        pattern = COPYRIGHT.replace("(?=\\n|$)", "")
        out = f"regexp_replace(lower(coalesce({text}, '')), {lit(pattern)}, '\\1', 'g')"
        out = f"regexp_replace({out}, {lit(NOT_WORDS)}, ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {lit(a)}, {lit(b)})"
        return out

    whole = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({lit(n)}, {lit(t)})" for n, t in LICENSES)
    given = ", ".join(f"({lit(n)}, {lit(d)})" for n, d, _ in DIGESTS)
    return f"""
with known as (select digest, min(license) as license from (select sha256({whole(form("text"))}) as digest, license from (values {values}) as v(license, text)
  union all select digest, license from (values {given}) as w(license, digest)) group by 1),
forms as (select doc_id, {form("text")} as lines from documents),
numbered as (select row_number() over () as row, doc_id, lines from forms),
hits as (select row, count(*) as n, string_agg(distinct license, ',' order by license) as notices
  from (select row, unnest(string_split(lines, chr(10))) as line from numbered) join known on sha256(trim(line)) = digest group by row)
select doc_id, sha256({whole("lines")}) as digest, k.license as license, coalesce(h.n, 0) as n_notices, h.notices as notices
from numbered left join known k on k.digest = sha256({whole("lines")}) left join hits h using (row)"""
