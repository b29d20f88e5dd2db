"""Licence scans by canonical digest, in Spark SQL expressions only.

A text is brought to a canonical form (copyright lines left out, lower case, every run of
characters that are no letters or digits one space, equivalent spellings made one), and the
SHA-256 of the whole canonical text is looked up in a table of known texts by an equi-join.
Units are the entire document and each of its lines: documents that are a licence, and
documents that state theirs in a line.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as one (the words of the right replace those of the left).
EQUIVALENT = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("noncommercial", "non commercial"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"))
#: A copyright notice, behind comment marks or not: with a sign, a year, a place for one, or a holder (a capital, or "by"). A line of a
#: licence that merely starts with the word has none of them. The pattern is one that Java and RE2 read alike.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%!<>|.-]*(?:(?i:copyright|spdx-filecopyrighttext)[ \t:]*(?:(?i:\(c\)|©|&copy;)|[12][0-9]{3}|[\[<{])|(?i:copyright[ \t]+by[ \t])|Copyright[ \t:]+(?:[Tt]he[ \t]+)?\p{Lu}|(?i:\(c\)[ \t]*(?:copyright|[12][0-9]{3}))|©)[^\n]*$|(?i:all rights reserved\.?)"
NO_WORD = r"[^\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License");',
    "you may not use this file except in compliance with the License.",
    'You may obtain a copy of the License at\n{}://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)


def _listed(head: str, items: tuple[str, ...], tail: str = "") -> tuple[str, str]:
    """A text with its items numbered, and with bullets."""
    return tuple("\n".join((head, *(mark.format(k) + i for k, i in enumerate(items, 1)), tail)) for mark in ("{}. ", "* "))


#: Identifier, titles, texts: each text is known without a title and with each one.
_TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), (_MIT,)),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), (_ISC, _ISC.replace("and/or", "and"))),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"), (_0BSD,)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), _listed(_BSD[0], _BSD[1:3], _BSD[4])),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'), _listed(_BSD[0], _BSD[1:4], _BSD[4])),
    ("Zlib", ("zlib License", "The zlib License", "The zlib/libpng License"), _listed(_ZLIB[0], _ZLIB[1:])),
    ("Unlicense", ("The Unlicense",), (_UNLICENSE, f"{_UNLICENSE}\nFor more information, please refer to <https://unlicense.org>", f"{_UNLICENSE}\nFor more information, please refer to <https://unlicense.org/>", f"{_UNLICENSE}\nFor more information, please refer to <http://unlicense.org/>")),
    ("Apache-2.0", (), (_APACHE[0], " ".join(_APACHE[:2]), *("\n".join(_APACHE).format(scheme) for scheme in ("http", "https")))),
)

#: Names that notices use, and the identifier of each.
_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0",),
    **{f"{short}-{v}.0": (f"GNU {long}General Public License, version {v}", f"GNU {long}General Public License version {v}.0") for short, long, versions in (("GPL", "", (2, 3)), ("LGPL", "Lesser ", (3,)), ("AGPL", "Affero ", (3,))) for v in versions},
    **{f"CC-{kind}-{v}": (f"CC {kind} {v}",) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
    "CC0-1.0": ("CC0 1.0",),
}
_PHRASES = ("{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This software is licensed under the {}")
_SPDX = dict.fromkeys((*(i for i, _, _ in _TEXTS), *_NAMES, *(f"{i}-{kind}" for i in _NAMES if "GPL" in i for kind in ("only", "or-later"))))
KNOWN = (
    *((i, f"{title}\n{text}") for i, titles, texts in _TEXTS for title in ("", *titles) for text in texts),
    *((i, f"SPDX-License-Identifier: {i}") for i in _SPDX),
    *((i, p.format(n)) for i, names in _NAMES.items() for n in names for p in _PHRASES),
)

#: SHA-256 of the canonical form of long texts, each as a whole and up to the end of its terms, with the two addresses
#: of the Free Software Foundation and with http and https. A change of the canonical form needs new ones; a test says so.
DIGESTS = {
    "Apache-2.0": (
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
        "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959",
        "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
        "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GPL-2.0": (
        "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
        "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca",
        "8d657eea7cb55320b5a1f94aae724b61dd96d5bbef37505b32f0c80ec1f15cca",
        "448cf8c5c0971f72c82bb38d9ddaa10b773a02e96799f6ee8ade3a5c7ddb3161",
    ),
    "GPL-3.0": (
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb",
        "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "Artistic-1.0-Perl": (
        "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8",
    ),
    "BSD-3-Clause": (
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ),
    "GFDL-1.2": (
        "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
        "8d636e2e2f248f9b102e9d9f78337901ec8bca3bfe91434cdcf261a01bf305b1",
    ),
    "GFDL-1.3": (
        "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
        "8b8b57bd195ed50d50edb5da1dd173b409fb9b075910c69726be7d0363c40008",
    ),
    "GPL-1.0": (
        "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
        "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
    ),
    "LGPL-2.0": (
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    ),
    "MPL-1.1": (
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
        "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87",
    ),
}


def canonical(text: Column) -> Column:
    """The canonical form; empty if no letter or digit is left."""
    # Two spaces between words, so that every word has its own on either side and equal neighbours are all replaced.
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " ")), NO_WORD, "  "), F.lit(" "))
    for was, now in EQUIVALENT:
        out = F.replace(out, F.lit(f" {was.replace(' ', '  ')} "), F.lit(f" {now.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_table(spark: SparkSession, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """license_id, text"""
    return spark.createDataFrame(list(known), "license_id string, text string")


def digest_table(spark: SparkSession, digests: dict[str, tuple[str, ...]] = DIGESTS) -> DataFrame:
    """license_id, digest"""
    return spark.createDataFrame([(i, d) for i, found in digests.items() for d in found], "license_id string, digest string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id (of the entire text, else null), line_licenses (of its lines, sorted, comma-joined), n_lines.

    Known are the texts of ``known`` and those whose canonical form has one of ``digests``.
    One row for each row of ``docs``. A null or empty text has no licence. Of several identifiers
    of one canonical text the first in order counts. Lines shorter than the shortest known form
    by as much as a spelling can add cannot become one of them and are not hashed.
    """
    listed = known.select("license_id", canonical(F.col("text")).alias("form")).dropna().filter("form <> ''")
    listed = listed.select("license_id", F.sha2("form", 256).alias("digest"), F.char_length("form").alias("size"))
    if digests is not None:
        listed = listed.unionByName(digests.select("license_id", "digest"), allowMissingColumns=True)
    listed = listed.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("size").alias("size"))
    least = listed.agg(F.min("size")).first()[0] or 0
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_digest", F.sha2("text", 256))
    lines = base.filter(F.col("text").isNotNull()).select("doc_id", "text_digest", F.posexplode(F.split("text", "\n")).alias("line", "part")).filter(F.char_length("part") >= least // 2)
    lines = lines.withColumn("digest", F.sha2(canonical(F.col("part")), 256)).join(listed, "digest")
    lines = lines.groupBy("doc_id", "text_digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.countDistinct("line").alias("n_lines"))
    whole = base.select("doc_id", "text_digest", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(listed, "digest", "left").select("doc_id", "text_digest", "license_id")
    same = whole["doc_id"].eqNullSafe(lines["doc_id"]) & (whole["text_digest"] == lines["text_digest"])
    return whole.join(lines, same, "left").select(whole["doc_id"], "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


def _sql_form(text: str) -> str:
    out = f"' ' || regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT_LINE}', ' ', 'g')), '{NO_WORD}', '  ', 'g') || ' '"
    for was, now in EQUIVALENT:
        out = f"replace({out}, ' {was.replace(' ', '  ')} ', ' {now.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


SQL = f"""
WITH k(license_id, text) AS (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)}),
n(license_id, digest) AS (VALUES {", ".join(f"('{i}', '{d}')" for i, found in DIGESTS.items() for d in found)}),
l AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({_sql_form("text")}) AS digest FROM k UNION ALL SELECT * FROM n) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
p AS (SELECT rid, unnest(string_split(text, chr(10))) AS part FROM d),
q AS (SELECT rid, sha256({_sql_form("part")}) AS digest FROM p),
m AS (SELECT q.rid, string_agg(DISTINCT l.license_id, ',' ORDER BY l.license_id) AS line_licenses, count(*) AS n_lines FROM q JOIN l ON l.digest = q.digest GROUP BY q.rid),
w AS (SELECT rid, sha256({_sql_form("text")}) AS digest FROM d)
SELECT d.doc_id, l.license_id, coalesce(m.line_licenses, '') AS line_licenses, coalesce(m.n_lines, 0) AS n_lines
FROM d LEFT JOIN m ON m.rid = d.rid JOIN w ON w.rid = d.rid LEFT JOIN l ON l.digest = w.digest
"""
