"""License scans by canonical digest lookup, with built-in functions only.

Texts are brought to a canonical form: lower case, copyright lines removed, punctuation
as spaces, equivalent spellings unified. The SHA-256 digests of the whole canonical text,
of each of its lines, and of blocks of words are looked up by a hash join among the digests
of known licenses, which are made by the same rules. A block begins at a line whose first
words are those of a known license and has as many words as that one, so a license inside
a longer text is found however its lines are wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolith.llm.common import sized, whole_text

#: Rules in order: pattern and replacement, in syntax that Java and RE2 share. Line ends are kept.
#: A notice names its sign, a year or an owner; a wrapped line that only begins with the word is text.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright\b[^a-z0-9\n]*(?:c\)|©|[0-9]|by\b)|\(c\)[^a-z\n]*[0-9]|©|all rights reserved)[^\n]*$"
RULES = (
    (COPYRIGHT_LINE, ""),
    (r"https?://", " "),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"licence", "license"),
    (r"sub license", "sublicense"),
    (r"non commercial", "noncommercial"),
    (r"favour", "favor"),
    (r"organis", "organiz"),
    (r"merchantib", "merchantab"),
    (r"fulfil\b", "fulfill"),
    (r" *\n *", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
    (r"\n+", "\n"),
)

# License texts, as published, and the sentences by which works name them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
}
#: Lines that stand above the texts in license files.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
}
#: Names by which the sentences below speak of a license.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",),
}
SENTENCES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.")


# License files as published, whole, by the first words of their canonical form, its number of words and its digest.
FILES = (
    ("Apache-2.0", "apache license", 1606, "a4f911b2a0171adfa435c489bd27ef49fa3a5e3bc30977345b5a9edb5d1cb6cb"),
    ("Artistic-1.0", "the artistic license", 983, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "redistribution and use", 214, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "creative commons legal", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free documentation", 3314, "d0d142139ba117e0fbb63d29df37776bc9c765c015720dc0ed43bceea6416494"),
    ("GFDL-1.3", "gnu free documentation", 3730, "2cdb48855af1603586f28b20f0095e588a4bd77ee484d2c3b89bc3b1f0b61da5"),
    ("GPL-1.0", "gnu general public", 2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "gnu general public", 2975, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "gnu general public", 5681, "24cd241e223e73eb1af195b9e4c0baf03a79bbbb39987eca0e347c1e490442aa"),
    ("LGPL-2.0", "gnu library general", 4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "gnu lesser general", 4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "gnu lesser general", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license", 3785, "e4d7347f1855f056365c08ad8030307f5cda3d38c9658d4f4db9a7c0aaac6c53"),
    ("MPL-2.0", "mozilla public license", 2425, "b59ad31436b35a95a00cff48e84c1f014339f59fac784c1935fc6f7dc34abf70"),
)
#: Words of a line by which blocks are found, and the least words of a license that is looked for as a block.
HEAD_WORDS, BLOCK_WORDS = 3, 12
#: Kinds of blocks that one scan looks for at most.
MOST_BLOCKS = 5000


def known_licenses() -> list[tuple[str, str]]:
    """(license_id, text) of all known licenses, their texts with and without a title; sentences are made from the names."""
    rows = [*TEXTS.items(), *NOTICES.items()]
    rows += [(key, f"{title}\n\n{TEXTS[key]}") for key, titles in TITLES.items() for title in titles]
    rows += [(key, sentence.format(name)) for key, names in NAMES.items() for name in names for sentence in SENTENCES]
    rows += [(key, f"SPDX-License-Identifier: {key}") for key in NAMES]
    return list(dict.fromkeys(rows))


def license_table(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(known_licenses() if rows is None else rows, "license_id string, text string")


def canonical(text: Column) -> Column:
    """The canonical form of a text, with its lines."""
    out = F.lower(text)
    for pattern, replacement in RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def _digest(line: Column) -> Column:
    return F.sha2(F.replace(line, F.lit("\n"), F.lit(" ")), 256)


def _head(line: Column) -> Column:
    return F.substring_index(line, " ", HEAD_WORDS)


def _words(form: Column) -> Column:
    return F.split(form, r"[ \n]")


def digest_table(licenses: DataFrame, files: tuple[tuple[str, str, int, str], ...] = FILES) -> DataFrame:
    """(license_id, digest, head, n_words) of licenses (license_id, text) and of files known by their digest alone."""
    forms = licenses.where("license_id is not null").select("license_id", canonical(whole_text()).alias("form")).where("form <> ''")
    made = forms.select("license_id", _digest(F.col("form")).alias("digest"), _head(F.get(F.split("form", "\n"), F.lit(0))).alias("head"), F.size(_words(F.col("form"))).alias("n_words"))
    listed = licenses.sparkSession.createDataFrame(list(files), "license_id string, head string, n_words int, digest string")
    return made.unionByName(listed).distinct()


def _block_digests(blocks: list[tuple[str, int]]) -> Column:
    """Digests of the words behind each line of ``form`` that begins like a known license, as many as that one has."""
    known: dict[str, list[int]] = {}
    for head, n in blocks:
        known.setdefault(head, []).append(n)
    none = F.array().cast("array<string>")
    if not known:
        return none
    lines, words = F.split("form", "\n"), _words(F.col("form"))
    sizes = F.create_map(*[x for head, ns in sorted(known.items()) for x in (F.lit(head), F.array(*[F.lit(n) for n in sorted(ns)]))])
    places = F.array().cast("array<struct<at:int,head:string>>")

    def step(state: Column, line: Column) -> Column:
        here = F.array(F.struct(state["at"].alias("at"), _head(line).alias("head")))
        starts = F.when(_head(line).isin(list(known)), F.concat(state["starts"], here)).otherwise(state["starts"])
        return F.struct((state["at"] + F.size(F.split(line, " "))).alias("at"), starts.alias("starts"))

    starts = F.aggregate(lines, F.struct(F.lit(1).alias("at"), places.alias("starts")), step, lambda state: state["starts"])

    def of(start: Column) -> Column:
        fitting = F.filter(F.element_at(sizes, start["head"]), lambda n: start["at"] + n - 1 <= F.size(words))
        return F.transform(fitting, lambda n: F.sha2(F.array_join(F.slice(words, start["at"], n), " "), 256))

    found = F.array_distinct(F.flatten(F.transform(starts, of)))
    return F.when(F.exists(lines, lambda line: _head(line).isin(list(known))), found).otherwise(none)


def scan(docs: DataFrame, licenses: DataFrame, files: tuple[tuple[str, str, int, str], ...] = FILES) -> DataFrame:
    """(doc_id, whole_license, licenses, n_licenses), one row per row of ``docs``.

    whole_license is the license (the first by name) whose text the whole document is;
    licenses lists, by name and comma-joined, those that the whole document, one of its
    lines, or a block of its words is (blocks of BLOCK_WORDS words at least). Null and empty
    texts hold none, and a text that is empty in canonical form matches nothing. Rows that
    repeat a doc_id share what their texts hold; rows without one get none. Only doc_id,
    text and license_id, text are read. The kinds of blocks are read first, MOST_BLOCKS at most.
    """
    table = digest_table(licenses, files)
    blocks = [tuple(r) for r in table.where(F.col("n_words") >= BLOCK_WORDS).select("head", "n_words").distinct().orderBy("head", "n_words").limit(MOST_BLOCKS + 1).collect()]
    if len(blocks) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} kinds of blocks")
    forms = docs.where("doc_id is not null").select("doc_id", canonical(whole_text()).alias("form")).where("form <> ''")
    unit = "struct<unit:string,is_whole:boolean,digest:string>"
    whole = F.array(F.struct(F.col("form").alias("unit"), F.lit(True).alias("is_whole"), F.lit(None).cast("string").alias("digest")).cast(unit))
    lines = F.transform(F.array_distinct(F.split("form", "\n")), lambda line: F.struct(line.alias("unit"), F.lit(False).alias("is_whole"), F.lit(None).cast("string").alias("digest")).cast(unit))
    inner = F.transform(_block_digests(blocks), lambda x: F.struct(F.lit(None).cast("string").alias("unit"), F.lit(False).alias("is_whole"), x.alias("digest")).cast(unit))
    units = forms.select("doc_id", F.explode(F.concat(whole, lines, inner)).alias("u")).select("doc_id", "u.is_whole", F.coalesce("u.digest", _digest(F.col("u.unit"))).alias("digest"))
    hits = units.join(sized(table.select("license_id", "digest").distinct()), "digest")
    found = hits.groupBy("doc_id").agg(
        F.min(F.when(F.col("is_whole"), F.col("license_id"))).alias("whole_license"), F.array_sort(F.collect_set("license_id")).alias("ids")
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        "whole_license",
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("ids").cast("long"), F.lit(0).cast("long")).alias("n_licenses"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    return scan(read_table(spark, sf_dir, "documents"), license_table(spark))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    out = f"lower({column})"
    for pattern, replacement in RULES:
        new = "chr(10)" if replacement == "\n" else _sql_text(replacement)
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {new}, 'g')"
    return out


def oracle() -> str:
    """The same scan in SQL, over the same license texts and files."""
    values = ", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in known_licenses())
    files = ", ".join(f"({_sql_text(k)}, {_sql_text(head)}, {n}, {_sql_text(digest)})" for k, head, n, digest in FILES)
    return f"""
with known(license_id, text) as (values {values}), files(license_id, head, n_words, digest) as (values {files}),
kf as (select distinct license_id, {_canonical_sql("text")} as form from known),
forms as (select license_id, array_to_string(list_slice(string_split(string_split(form, chr(10))[1], ' '), 1, {HEAD_WORDS}), ' ') as head,
  len(string_split(replace(form, chr(10), ' '), ' ')) as n_words, sha256(replace(form, chr(10), ' ')) as digest from kf union select * from files),
blocks as (select distinct head, n_words from forms where n_words >= {BLOCK_WORDS}),
docs as (select doc_id, {_canonical_sql("coalesce(text, '')")} as form from documents),
lines as (select doc_id, unnest(string_split(form, chr(10))) as line, generate_subscripts(string_split(form, chr(10)), 1) as i from docs where form <> ''),
places as (select *, array_to_string(list_slice(string_split(line, ' '), 1, {HEAD_WORDS}), ' ') as head,
  coalesce(sum(len(string_split(line, ' '))) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as words_before from lines),
inner_units as (select p.doc_id, array_to_string(list_slice(string_split(replace(form, chr(10), ' '), ' '), cast(words_before as bigint) + 1, cast(words_before as bigint) + n_words), ' ') as unit
  from places p join blocks using (head) join docs using (doc_id) where words_before + n_words <= len(string_split(replace(form, chr(10), ' '), ' '))),
units as (select doc_id, true as is_whole, replace(form, chr(10), ' ') as unit from docs where form <> ''
  union all select doc_id, false, line from lines union all select doc_id, false, unit from inner_units),
hits as (select doc_id, license_id, is_whole from units join forms on sha256(unit) = digest),
found as (select doc_id, min(case when is_whole then license_id end) as whole_license,
  string_agg(distinct license_id, ',' order by license_id) as licenses, count(distinct license_id) as n_licenses from hits group by doc_id)
select documents.doc_id, whole_license, coalesce(licenses, '') as licenses, coalesce(n_licenses, 0) as n_licenses
from documents left join found using (doc_id)
"""
