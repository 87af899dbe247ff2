"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, copyright notices and list marks removed, equivalent spellings unified, punctuation
and runs of white space turned into single blanks. Entire texts are then looked up by the digest of their canonical form: the whole
document, and each of its lines taken as a text of its own, since notices stand on a line in otherwise unrelated documents. The known
digests are a fixed short list, so the hash join broadcasts them and moves no document.

A notice is "copyright" followed at once by (c), a year, "by" or a placeholder for them, so the licences' own lines that happen to begin
with the word stay. A notice goes to the end of its line, or up to the licence's opening words on the same line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known texts. Canonicalisation makes case, punctuation, wrapping, list marks and copyright notices irrelevant.
_MIT_HEAD = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so"""
_MIT_CONDITION = """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_MIT_TAIL = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"{_MIT_HEAD}{_MIT_CONDITION}{_MIT_TAIL}"
_MIT_0 = f"{_MIT_HEAD}.\n{_MIT_TAIL}"
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = f"{_ISC_HEAD}{_ISC_CONDITION}\n{_ISC_TAIL}"
_0BSD = f"{_ISC_HEAD}.\n{_ISC_TAIL}"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL_3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = [
    ("0BSD", _0BSD),
    ("0BSD", f"BSD Zero Clause License\n{_0BSD}"),
    ("0BSD", f"Zero-Clause BSD\n{_0BSD}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n{_BOOST}"),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_NAMES}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_NAMES}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_3_NOTICE),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", _ISC),
    ("ISC", f"ISC License\n{_ISC}"),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-0", _MIT_0),
    ("MIT-0", f"MIT No Attribution\n{_MIT_0}"),
    ("MPL-2.0", _MPL_NOTICE),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n{_ZLIB}"),
]
# sha256 of the canonical form of long texts as their stewards publish them.
KNOWN_DIGESTS = [
    ("Apache-2.0", "f213b407df637bc294997de205aecfc82e06a5e4ef6d75893ec348ca26dd13c2"),
    ("CC0-1.0", "b0fc18a015ac75b80d4ada9c70af34a66cb5be237c7feaa15c8394c996bd805c"),
    ("GPL-2.0", "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1"),
    ("GPL-3.0", "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64"),
    ("LGPL-2.1", "3c172029ca14deedef915e5d03e83bcc73647736d10c2be07d384571ca06b440"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-2.0", "59b3cfad44310e04e6b1a22e219cf49fe1a933822f1704098f34cbb73d8a28fb"),
]

# Spellings taken as equal (before, after), applied in this order.
SPELLINGS = [
    ("licence", "license"), ("sub-licens", "sublicens"), ("sub licens", "sublicens"), ("non-infring", "noninfring"), ("non infring", "noninfring"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("favour", "favor"), ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
    ("https:", "http:"), ("&", " and "),
]
# A copyright notice from its first word; what a licence opens with; a list mark at the start of a line or after a stop.
NOTICE = r"(?:copyright[ \t:,]*(?:\(c\)|©|by\b|(?:19|20)\d\d|\[yyyy\]|<year>)|\(c\)[ \t]*(?:19|20)\d\d|©)"
OPENING = (
    r"(permission is hereby granted|permission to use|redistribution and use|licensed under|released under|this software is provided|"
    r"the software is provided|this program is free|this is free and|this work is licensed|this source code form|boost software license|spdx-license)"
)
NOTICE_BEFORE_TEXT = NOTICE + r"[^\n]{0,400}?" + OPENING
NOTICE_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:" + NOTICE + r"[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
LIST_MARK = r"(^|[\n.;:,])[^\p{L}\p{N}\n.;:,(]*\(?(?:\d{1,2}|[a-h])[.)][ \t]+"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have any word, as an array; of no text, none."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in ((NOTICE_BEFORE_TEXT, "$1"), (NOTICE_LINE, ""), (LIST_MARK, "$1 "), (PUNCTUATION, " ")):
        out = F.regexp_replace(out, pattern, new)
    return F.filter(F.transform(F.split(out, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """``license, digest`` of the known texts, and of those known by digest alone. A licence of no words is left out."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    told = rows.select("license", whole.alias("whole")).filter("whole <> ''").select("license", _digest(F.col("whole")).alias("digest"))
    return told.unionByName(spark.createDataFrame(list(digests), "license string, digest string")).distinct()


def license_hits(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: Sequence[tuple[str, str]] = KNOWN,
    digests: Sequence[tuple[str, str]] = KNOWN_DIGESTS,
) -> DataFrame:
    """One row per document, licence and scope: ``doc_id, license, scope, hits``.

    Scope ``text``: the entire text is the licence; ``line``: so many lines are each a known text. A document of one line counts
    as a text only. Documents without a hit have no row; null, empty and wordless texts have none. Repeated rows and rows of one id
    add their hits up; null ids share the null id. Other columns are not read.
    """
    lines = docs.select(F.col(f"`{id_col}`").alias(id_col), canonical_lines(F.col(f"`{text_col}`")).alias("lines")).filter(F.size("lines") > 0)
    whole = F.struct(F.lit("text").alias("scope"), _digest(F.array_join("lines", " ")).alias("digest"))
    single = F.transform("lines", lambda line: F.struct(F.lit("line").alias("scope"), _digest(line).alias("digest")))
    units = lines.select(id_col, F.inline(F.when(F.size("lines") > 1, F.concat(F.array(whole), single)).otherwise(F.array(whole))))
    hits = units.join(F.broadcast(known_digests(docs.sparkSession, known, digests)), "digest")  # as many rows as known texts
    return hits.groupBy(id_col, "license", "scope").agg(F.count("*").alias("hits"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The rules of the canonical form, written apart from the code. The texts and digests themselves are the given data.
_SQL_SPELLINGS = [
    ("licence", "license"), ("sub-licens", "sublicens"), ("sub licens", "sublicens"), ("non-infring", "noninfring"), ("non infring", "noninfring"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("favour", "favor"), ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
    ("https:", "http:"), ("&", " and "),
]
_SQL_NOTICE = r"(?:copyright[ \t:,]*(?:\(c\)|©|by\b|(?:19|20)[0-9][0-9]|\[yyyy\]|<year>)|\(c\)[ \t]*(?:19|20)[0-9][0-9]|©)"
_SQL_STEPS = [
    (
        _SQL_NOTICE + r"[^\n]{0,400}?(permission is hereby granted|permission to use|redistribution and use|licensed under|released under|"
        r"this software is provided|the software is provided|this program is free|this is free and|this work is licensed|this source code form|"
        r"boost software license|spdx-license)",
        r"\1",
    ),
    (r"(?m)^[^\p{L}\p{N}\n(©]*(?:" + _SQL_NOTICE + r"[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$", ""),
    (r"(^|[\n.;:,])[^\p{L}\p{N}\n.;:,(]*\(?(?:[0-9]{1,2}|[a-h])[.)][ \t]+", r"\1 "),
    (r"[^\p{L}\p{N}\n]+", " "),
]


def _sql_lines(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for old, new in _SQL_SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    for pattern, new in _SQL_STEPS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


SQL = f"""
WITH given(license, text) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in KNOWN)}),
told(license, digest) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(d)})' for n, d in KNOWN_DIGESTS)}),
known AS (SELECT DISTINCT license, sha256(array_to_string({_sql_lines('text')}, ' ')) AS digest FROM given UNION SELECT * FROM told),
docs AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
units AS (SELECT doc_id, 'text' AS scope, array_to_string(lines, ' ') AS unit FROM docs WHERE len(lines) > 0
  UNION ALL SELECT doc_id, 'line', unnest(lines) FROM docs WHERE len(lines) > 1)
SELECT doc_id, license, scope, count(*) AS hits FROM (SELECT doc_id, scope, sha256(unit) AS digest FROM units) JOIN known USING (digest) GROUP BY ALL
"""
