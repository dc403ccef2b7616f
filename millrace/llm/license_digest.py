"""Licence scans by the digest of a canonical text, with DataFrame functions only.

The canonical text has lower-case words with single blanks between them: copyright statements (lines that begin with the
word or sign and a year, holder's mark or name in brackets, and "all rights reserved") go, all that is neither letter nor
digit separates words, and equivalent spellings become one. Entire texts are joined by their SHA-256 to the digests of
known licences: TEXTS with their usual headings and without, and DIGESTS of longer public texts. More of either may be given,
also as a table; Spark broadcasts it by its size. Licences are often named by a line of their own in a longer text; each
entire line that has a word of some notice is looked up by its digest in the same way (notices are a literal of the plan).

A text is made canonical once. Spellings are only replaced where one of them occurs, which one pattern tells. Documents are
not shuffled.

Defined results: null text counts as empty; an empty canonical text is no licence; a digest that several known texts
share names the first of their names; a repeated row gives a row each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPYRIGHT = r"(?m)^[ \t*#/]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[<\[{])|\(c\)[ \t]*(?:copyright|[0-9]{4})|©)[^\n]*|all rights reserved\.?[ \t\r]*$)"
NO_WORD = r"[^\p{L}\p{N}]+"
# Spellings that count as one (pattern of whole words, what they become); _ stands between words.
SPELLINGS = (
    ("(?:sublicence|sub_license|sub_licence)", "sublicense"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non_infringement"),
    ("copyright_owner", "copyright_holder"),
    ("copyright_owners", "copyright_holders"),
    ("http", "https"),
    ("v_([0-9]+)", "version_$1"),
)

# Publicly known short licence texts.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BODIES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMER),
    ("BSD-3-Clause", _CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
)
# Headings that stand above these texts.
_HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
}
TEXTS = tuple((name, head + text) for name, text in _BODIES for head in ("", *(h + "\n\n" for h in _HEADINGS[name])))
# SHA-256 of the canonical forms of longer public licences, whole and without what follows their terms.
DIGESTS = (
    ("Apache-2.0", "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("Apache-2.0", "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "4544af666fc42fe3ea03e86d5db9fef4f4c41c50c15f04550119fdb67822747b"),
)
# Notices that stand as a line of their own.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
)


def _spaced(spelling: str) -> str:
    return spelling.replace("_", "  ")


def plain(text):
    """Lower-case words of a text column with two blanks between them, so that each word has its own, and one at both ends."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NO_WORD, "  ")), F.lit(" "))


def spelled(words):
    """The canonical form of a result of `plain`."""
    one = reduce(lambda t, s: F.regexp_replace(t, f" {_spaced(s[0])} ", f" {_spaced(s[1])} "), SPELLINGS, words)
    some = words.rlike(" (?:" + "|".join(_spaced(s[0]) for s in SPELLINGS) + ") ")
    return F.trim(F.regexp_replace(F.when(some, one).otherwise(words), " +", " "))


def canonical(text):
    """The canonical form of a text column."""
    return spelled(plain(text))


def digest(text):
    return F.sha2(canonical(text), 256)


def _pairs(spark: SparkSession, pairs, name: str) -> DataFrame:
    """(license_id, name) of a list, as a literal of the plan."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias(name)) for i, t in pairs or (("", ""),)])
    return spark.range(1).select(F.explode(rows).alias("k")).select("k.license_id", f"k.{name}")


def known_digests(spark: SparkSession, known, digests=()) -> DataFrame:
    """(digest, license_id) of texts, as (license_id, text) pairs or a table of them, and of digests that are known already."""
    if not isinstance(known, DataFrame):
        known = _pairs(spark, known, "text")
    rows = known.select("license_id", canonical(F.col("text")).alias("c")).filter("c <> ''").select("license_id", F.sha2("c", 256).alias("digest"))
    if digests:
        rows = rows.unionByName(_pairs(spark, digests, "digest"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(spark: SparkSession, docs: DataFrame, texts=TEXTS, notices=NOTICES, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (the entire text is this licence, else null), notices (names, ascending, joined by commas), n_notices (lines)."""
    of_line = {r.digest: r.license_id for r in known_digests(spark, notices).collect()} if notices else {}
    whole = known_digests(spark, texts, digests).select(F.col("digest").alias("known"), "license_id")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc_id", plain(F.col("text")).alias("words"), _notice_names(F.col("text"), notices, of_line).alias("names"))
    docs = docs.select("doc_id", F.sha2(spelled(F.col("words")), 256).alias("digest"), "names")
    docs = docs.join(whole, F.col("digest") == F.col("known"), "left")
    return docs.select("doc_id", "digest", "license_id", F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("notices"), F.size("names").cast("long").alias("n_notices"))


def _anchor(notice: str) -> str:
    """A word that every line of the same canonical form as the notice has: the longest that no spelling makes or takes."""
    made = set(re.findall("[a-z0-9]+", " ".join(_spaced(x) for s in SPELLINGS for x in s)))
    return max((w for w in re.findall("[a-z]+", notice.lower()) if w not in made), key=len, default="")


def _notice_names(text, notices, of_line: dict[str, str]):
    if not of_line:
        return F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for pair in of_line.items() for x in pair])
    anchors = "(?i)" + "|".join(sorted({_anchor(t) for _, t in notices}))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(anchors))
    names = F.filter(F.transform(lines, lambda line: table[digest(line)]), lambda x: x.isNotNull())
    return F.when(text.rlike(anchors), names).otherwise(F.array().cast("array<string>"))


def sql(texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> str:
    """The same as one DuckDB statement."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def made(x: str) -> str:
        x = f"concat(' ', trim(regexp_replace(regexp_replace(lower({x}), {quoted(COPYRIGHT)}, '', 'g'), {quoted(NO_WORD)}, '  ', 'g'), ' '), ' ')"
        for a, b in SPELLINGS:
            x = f"regexp_replace({x}, {quoted(f' {a} '.replace('_', '  '))}, {quoted(f' {b} '.replace('_', '  ').replace('$', chr(92)))}, 'g')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"

    def table(known) -> str:
        return " UNION ALL ".join(f"SELECT {quoted(i)} license_id, {quoted(t)} t" for i, t in known)

    given = "".join(f" UNION ALL SELECT {quoted(d)}, {quoted(i)}" for i, d in digests)
    known = "SELECT sha256(c) digest, min(license_id) license_id FROM (SELECT license_id, {} c FROM ({})) WHERE c <> '' GROUP BY ALL"
    return f"""
WITH whole AS (SELECT digest, min(license_id) license_id FROM ({known.format(made("t"), table(texts))}{given}) GROUP BY digest), lines AS ({known.format(made("t"), table(notices))}),
    named AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) notices, count(*) n_notices
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents) JOIN lines ON sha256({made("line")}) = lines.digest GROUP BY doc_id),
    docs AS (SELECT doc_id, sha256({made("coalesce(text, '')")}) digest FROM documents)
SELECT d.doc_id, d.digest, license_id, coalesce(notices, '') notices, coalesce(n_notices, 0) n_notices
FROM docs d LEFT JOIN whole w ON d.digest = w.digest LEFT JOIN named n ON d.doc_id = n.doc_id"""
