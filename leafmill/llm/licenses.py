"""License scans: TF-IDF cosine to templates, then inheritance by directories.

Templates are titles, headers, texts and the usual one-line statements of public
licenses.  A file is compared with them as a whole and by its parts: lines,
sentences of lines and of paragraphs, paragraphs, runs of line comments and
block comments.  Parts and templates are sparse TF-IDF vectors: tf is
1 + ln(count); idf comes from the number of documents, of the corpus and the
templates, that have a token, and a token that no template has weighs like one
of a single document.  A part's tokens meet the templates' by an equi-join, once
for each different part.

No part is left out that could reach ``THRESHOLD``.  By the inequality of Cauchy
and Schwarz its shared tokens must hold THRESHOLD**2 of the template's squared
length, so it must have one of the template's rarest tokens (``gate``); and as
other tokens lengthen its own vector, it has few of them beside many shared ones.

The best template is the part's license, the best part's is the file's.  A file
that opens with its license, or is named like one, is its directory's license
file.  Files without a license of their own take that of the nearest directory
above that has one, by joining the paths of all their ancestors.  SPDX
expressions are taken as they stand.  Everything is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.joins import join_groups
from leafmill.scratch import Scratch, files_for, in_files

# Titles, headers, passages of the texts, and usual statements of public licenses.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU {name} for more details."
)
_GNU = (
    ("GPL-2.0", "General Public License", "2", "June 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"), ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
)
TEMPLATES = (
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "Released under the MIT License."), ("MIT", _MIT), ("MIT", _MIT + _MIT_REST),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "Licensed under the 2-clause BSD License."), ("BSD-2-Clause", _BSD + _BSD_REST),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "Licensed under the 3-clause BSD License."), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_REST),
    ("ISC", "ISC License"), ("ISC", "Licensed under the ISC License."),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies" + _ISC_REST),
    ("0BSD", "BSD Zero Clause License"), ("0BSD", _GRANT + _ISC_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0",
     "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("Apache-2.0",
     "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
     "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, "
     "publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    *((k, f"GNU {name} Version {v}, {day}") for k, name, v, day in _GNU),
    *((k, f"This work is licensed under the GNU {name}, version {v}.") for k, name, v, _ in _GNU),
    *((k, f"Licensed under the GNU {name}, version {v}.") for k, name, v, _ in _GNU),
    *((k, _GNU_HEADER.format(what="program", name=name, version=v)) for k, name, v, _ in _GNU),
    *((k, _GNU_HEADER.format(what="library", name=name, version=v)) for k, name, v, _ in _GNU if k[0] == "L"),
    ("GPL-2.0",
     "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is "
     "intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-3.0",
     "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, "
     "supplemented by the additional permissions listed below."),
    ("AGPL-3.0",
     "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure "
     "cooperation with the community in the case of network server software."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0",
     "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF "
     "THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("EPL-2.0",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
     "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
     "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Zlib", "zlib License"),
    ("Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
     "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
     "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
     "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense",
     "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
     "for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."), ("Proprietary", "No license is granted."),
)
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
THRESHOLD = 0.75
#: Tokens in a smaller share of the documents weigh alike.
RAREST = 1e-4
#: A license in so many first lines or sentences opens the file.
OPENING = 2
FILE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
# Parts, in patterns that Java and RE2 read alike.
_BEYOND = r"[^\x00-\x7F]+"
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
_CODE = r"^[ \t\r\n]*(?://|#|/\*|\*|--|;|%|<!--)"
_BLANK = r"\n[ \t]*(?://+|#+|\*+|;+|--+|%+)?[ \t\r]*\n"
_RUN = r"(?:(?:^|\n)[ \t]*(?://|#|;|--|%)[^\n]*)+"
_COMMENT = r"(?s:/\*.*?\*/|<!--.*?-->)"
_WHITE = " \t\r\n"


def tokens_of(text: str) -> list[str]:
    return re.findall(_TOKEN, re.sub(_BEYOND, " ", text).lower())


def vocabulary(templates: Sequence = TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in tokens_of(t)})


def any_of(words: Sequence[str]) -> str:
    """A pattern for any of these words that looks at each letter once."""
    heads = sorted({w[0] for w in words if w})
    if not heads:
        return "" if words else "(?!)"
    branches = [re.escape(h) + any_of([w[1:] for w in words if w[:1] == h]) for h in heads]
    one = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
    return one + "?" * ("" in words)


class Vectors:
    """Weights of the templates, and what passes the gate."""

    def __init__(self, df: dict[str, int], n: int, templates: Sequence = TEMPLATES, threshold: float = THRESHOLD):
        """``df``: documents of the corpus, of ``n``, that have a token."""
        counts = [Counter(tokens_of(t)) for _, t in templates]
        total = n + len(templates)
        have = Counter(w for c in counts for w in c)
        self.threshold = threshold
        self.idf = {w: 1 + math.log(1 / max((df.get(w, 0) + k) / total, RAREST)) for w, k in have.items()}
        self.other = 1 + math.log(1 / max(1 / total, RAREST))
        self.rows: list[tuple[int, str, str, float]] = []
        self.seen = {w for w, k in df.items() if k}
        self.gate: set[str] = set()
        for i, c in enumerate(counts):
            weights = {w: (1 + math.log(k)) * self.idf[w] for w, k in c.items()}
            size = math.sqrt(sum(x * x for x in weights.values()))
            self.rows += [(i, templates[i][0], w, x / size) for w, x in sorted(weights.items())]
            left = size * size
            for w in sorted(weights, key=lambda w: (-self.idf[w], w)):
                if left < (threshold - 1e-5) ** 2 * size * size:
                    break
                self.gate.add(w)
                left -= weights[w] ** 2

    def gate_pattern(self) -> str:
        """Words that no document has need not be looked for."""
        return rf"(?<![a-z0-9])(?:{any_of(sorted(self.gate & self.seen))})(?![a-z0-9])"

    def may_reach(self, said: Column) -> Column:
        """False only for parts that no template can fit.  With k different
        shared tokens, m of them in all, a vector's shared part has a squared
        length of k (1 + ln(m / k))**2 times the greatest squared weight at
        most, as the squares of 1 + ln are concave; each other token adds its
        square to the whole."""
        most = max(self.idf.values()) ** 2 * (1 / (self.threshold - 1e-5) ** 2 - 1)
        vocab = F.lit(sorted(self.idf))

        def fits(t: Column) -> Column:
            shared, others = t["shared"], t["kinds"] - t["shared"]
            log = 1 + F.log((t["all"] - others) / F.greatest(shared, F.lit(1)))
            return (shared > 0) & (others * self.other**2 <= shared * log * log * most)

        # Each step binds what it has computed as an element of an array.
        lists = F.transform(F.array(tokens(said)), lambda t: F.struct(F.size(t).alias("all"), F.array_distinct(t).alias("kinds")))
        sizes = F.transform(
            lists, lambda t: F.struct(t["all"].alias("all"), F.size(t["kinds"]).alias("kinds"), F.size(F.array_intersect(t["kinds"], vocab)).alias("shared"))
        )
        return F.exists(sizes, fits)


def plain(text: Column) -> Column:
    """Lower case, and a space for whatever is beyond ASCII."""
    return F.lower(F.regexp_replace(text, _BEYOND, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[a-z0-9]++(?:\.[0-9]++)*+"), F.lit(0))


def parts(text: Column) -> Column:
    """Array of (at, said) of a plain text.  ``at`` below ``OPENING`` is for
    parts that open the file; none does if it begins with a comment."""
    code = text.rlike(_CODE)
    trim = lambda x: F.btrim(x, F.lit(_WHITE))
    trimmed = lambda a: F.filter(F.transform(a, trim), lambda x: x != "")
    put = lambda at: lambda x, i: F.struct(F.when(code, OPENING).otherwise(at(i)).alias("at"), x.alias("said"))
    paragraphs = trimmed(F.split(text, _BLANK))
    ends = lambda p: F.split(F.regexp_replace(F.regexp_replace(p, "[ \t\r\n]+", " "), "([.!?;]) ", "$1\n"), "\n")
    sentences = trimmed(F.flatten(F.transform(paragraphs, ends)))
    within = trimmed(F.split(F.regexp_replace(text, "([.!?;])[ \t]+", "$1\n"), "\n"))
    runs = F.regexp_extract_all(text, F.lit(r"(?:(?:^|\n)[ \t]*+(?://|#|;|--|%)[^\n]*+)++"), F.lit(0))
    comments = F.regexp_extract_all(text, F.lit(_COMMENT), F.lit(0))
    place = lambda i: F.least(i, F.lit(OPENING))
    first = lambda i: F.when(i == 0, 0).otherwise(OPENING)
    never = lambda _: F.lit(OPENING)
    return F.concat(
        F.transform(trimmed(F.array(text)), put(first)),
        F.transform(paragraphs, put(first)),
        F.transform(trimmed(F.split(text, "\n")), put(place)),
        F.transform(sentences, put(place)),
        F.transform(within, put(place)),
        F.transform(trimmed(F.concat(runs, comments)), put(never)),
    )


def document_frequencies(texts: DataFrame, vocab: Sequence[str]) -> dict[str, int]:
    """How many rows of (text) have each of these tokens."""
    found = texts.select(F.explode(F.array_intersect(tokens(plain(F.col("text"))), F.lit(list(vocab)))).alias("token"))
    return {r.token: r.n for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def classify(said: DataFrame, vectors: Vectors) -> DataFrame:
    """(keys, license, score) of the rows of (keys..., said), one for each key,
    that any template fits."""
    spark = said.sparkSession
    keys = [c for c in said.columns if c != "said"]
    # Arrow tables become local relations; lists of tuples would pass through Python workers.
    t, license_, token, weight = zip(*vectors.rows, strict=True)
    rows = spark.createDataFrame(pa.table({"t": pa.array(t, pa.int32()), "license": license_, "token": token, "weight": weight}))
    idf = spark.createDataFrame(pa.table({"token": list(vectors.idf), "idf": list(vectors.idf.values())}))
    tf = said.select(*keys, F.explode(tokens(F.col("said"))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idf), "token", "left")
    tf = tf.withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(vectors.other)))
    size = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = tf.join(F.broadcast(rows), "token").groupBy(*keys, "t", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(size, keys).select(*keys, "license", F.round(F.col("dot") / F.col("size"), 6).alias("score"))
    best = F.max(F.struct("score", "license")).alias("b")
    return cosine.where(F.col("score") >= vectors.threshold).groupBy(*keys).agg(best).select(*keys, "b.license", "b.score")


def directory(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


_KEY = ("k1", "k2")


def found_parts(df: DataFrame, vectors: Vectors) -> DataFrame:
    """(row, id, path, parts, spdx) of the rows of (id, path, text): the parts
    that a template may fit, and SPDX expressions."""
    gate = vectors.gate_pattern()
    fits = lambda p: p["said"].rlike(gate) & vectors.may_reach(p["said"])
    low, text = F.col("low"), F.col("text")
    return df.withColumn("low", plain(text)).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "path",
        F.when(low.rlike(gate), F.filter(F.array_distinct(parts(low)), fits)).alias("parts"),
        F.when(text.contains("SPDX-License-Identifier:"), F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))).alias("spdx"),
    )


def own_licenses(rows: DataFrame, vectors: Vectors, scratch: Scratch, files: int | None = None) -> DataFrame:
    """(row, path, own_license, own_score, opens) of the rows of ``found_parts``
    that have a license of their own.  ``files``: of a scratch table, at most."""
    compared = rows.select("row", "path", F.explode("parts").alias("p")).select("row", "path", "p.*")
    compared = compared.withColumns({k: F.xxhash64(F.lit(i), "said") for i, k in enumerate(_KEY)})
    distinct = compared.groupBy(*_KEY).agg(F.first("said").alias("said"), F.count(F.lit(1)).alias("n"))
    distinct = scratch.keep(in_files(distinct, files), "distinct")
    kinds = classify(distinct.drop("n"), vectors)
    kinds = scratch.keep(in_files(kinds.join(distinct.select(*_KEY, "n"), list(_KEY)), files), "kinds")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    named = join_groups(compared.drop("said"), kinds, _KEY, "n", total).select("row", "path", "at", "license", "score")
    stated = rows.select("row", "path", F.lit(OPENING).alias("at"), F.explode("spdx").alias("license"), F.lit(1.0).alias("score"))
    best = F.max(F.struct("score", "license", (-F.col("at")).alias("at"))).alias("b")
    own = named.unionByName(stated).groupBy("row", "path").agg(best)
    return own.select("row", "path", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"), (F.col("b.at") > -OPENING).alias("opens"))


def _above(dir_: Column) -> Column:
    """The directory and all above it, the top included."""
    steps = F.split(dir_, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    return F.concat(F.array(F.lit("")), F.when(dir_ == "", F.array().cast("array<string>")).otherwise(below))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, path, own_license, own_score, is_license_file, license, inherited_from)
    for each row.

    ``license`` is the file's own, else that of the nearest directory at or
    above its own with a license file, named in ``inherited_from``; null if
    there is none.  Of several license files in a directory the least path,
    then license, counts.  Of a file's parts the best score counts, then the
    greatest license name.  Null texts have no license of their own; null paths
    no directory.  Repeated rows come back as often, and count as often where
    documents are counted.  An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "licenses")
    docs = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{path_col}`").cast("string").alias("path"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    total, files = docs.count(), files_for(df)
    vectors = Vectors(document_frequencies(docs, vocabulary()), total)
    # Texts are scanned by as many tasks as they have pieces; the few rows' worth that they leave is dealt to few files.
    rows = scratch.keep(in_files(found_parts(docs, vectors).hint("rebalance", F.col("row")), files), "parts")
    own = own_licenses(rows, vectors, scratch, files)
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    own = own.withColumn("is_license_file", (F.col("opens") | named) & F.col("path").isNotNull()).drop("opens")

    declared = own.where("is_license_file").groupBy(directory(F.col("path")).alias("up"))
    declared = declared.agg(F.min(F.struct("path", F.col("own_license").alias("license"))).alias("d")).select("up", "d.license")
    dirs = rows.groupBy(directory(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    dirs = scratch.keep(in_files(dirs, files), "dirs")
    ups = dirs.where("dir is not null").select("dir", F.explode(_above(F.col("dir"))).alias("up"))
    below = ups.groupBy("up").agg(F.count(F.lit(1)).alias("below"))
    declared = scratch.keep(in_files(declared.join(below, "up"), files), "declared")
    above = join_groups(ups, declared, ["up"], "below", ups.count())
    nearest = above.groupBy("dir").agg(F.max(F.struct(F.length("up"), "up", "license")).alias("m")).select(F.col("dir").alias("d"), "m.up", "m.license")
    groups = dirs.join(nearest, dirs["dir"] == nearest["d"], "left").drop("d")
    out = rows.select("row", "id", "path", directory(F.col("path")).alias("dir")).join(own.drop("path"), "row", "left")
    none = F.col("own_license").isNull()
    return in_files(join_groups(out, groups, ["dir"], "n", total), files).select(
        F.col("id").alias(id_col),
        "path",
        "own_license",
        "own_score",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "license").alias("license"),
        F.when(none & F.col("license").isNotNull(), F.col("up")).alias("inherited_from"),
    )


def oracle(path_sql: str) -> str:
    """DuckDB SQL for ``scan`` over documents with this path; without the gate."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quote(k)}, {quote(t)})" for i, (k, t) in enumerate(TEMPLATES))
    dir_ = lambda p: f"regexp_replace({p}, '/?[^/]*$', '')"
    list_ = lambda x: f"regexp_extract_all({x}, '{_TOKEN}')"
    white = "' ' || chr(9) || chr(13) || chr(10)"
    trimmed = lambda a: f"list_filter(list_transform({a}, lambda x: trim(x, {white})), lambda x: x <> '')"
    weight = "(1 + ln(tf)) * idf"
    return rf"""
WITH t(t, license, said) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {path_sql} AS path, coalesce(text, '') AS raw,
  lower(regexp_replace(coalesce(text, ''), '{_BEYOND}', ' ', 'g')) AS low FROM documents),
tt AS (SELECT t, license, token, count(*) AS tf FROM (SELECT t, license, unnest({list_("lower(said)")}) AS token FROM t) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM d) + (SELECT count(*) FROM t) AS n),
df AS (SELECT token, count(*) AS df FROM (SELECT rid, unnest(list_distinct({list_("low")})) AS token FROM d UNION ALL SELECT t, token FROM tt)
  WHERE token IN (SELECT token FROM tt) GROUP BY token),
idf AS (SELECT token, 1 + ln(1 / greatest(df / n::DOUBLE, {RAREST}::DOUBLE)) AS idf FROM df, n),
o AS (SELECT 1 + ln(1 / greatest(1 / n::DOUBLE, {RAREST}::DOUBLE)) AS other FROM n),
tw AS (SELECT t, license, token, {weight} AS x FROM tt JOIN idf USING (token)),
v AS (SELECT t, license, token, x / sqrt(sum(x * x) OVER (PARTITION BY t)) AS x FROM tw),
g AS (SELECT *, regexp_matches(low, '{_CODE}') AS code, {trimmed(f"string_split_regex(low, '{_BLANK}')")} AS paragraphs FROM d),
p AS (SELECT rid, path, code, 'first' AS kind, {trimmed("[low]")} AS a FROM g
  UNION ALL SELECT rid, path, code, 'first', paragraphs FROM g
  UNION ALL SELECT rid, path, code, 'place', {trimmed("string_split(low, chr(10))")} FROM g
  UNION ALL SELECT rid, path, code, 'place', {trimmed(r"flatten(list_transform(paragraphs, lambda y: string_split(regexp_replace(regexp_replace(y, '[ \t\r\n]+', ' ', 'g'), '([.!?;]) ', '\1' || chr(10), 'g'), chr(10))))")} FROM g
  UNION ALL SELECT rid, path, code, 'place', {trimmed(r"string_split(regexp_replace(low, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10))")} FROM g
  UNION ALL SELECT rid, path, true, 'place', {trimmed(f"regexp_extract_all(low, '{_RUN}') || regexp_extract_all(low, '{_COMMENT}')")} FROM g),
u AS (SELECT rid, path, code, kind, unnest(range(0, len(a))) AS i, unnest(a) AS said FROM p),
m AS (SELECT rid, path, said, CASE WHEN code THEN {OPENING} WHEN kind = 'first' THEN CASE WHEN i = 0 THEN 0 ELSE {OPENING} END ELSE least(i, {OPENING}) END AS spot FROM u),
tf AS (SELECT said, token, count(*) AS tf FROM (SELECT said, unnest({list_("said")}) AS token FROM (SELECT DISTINCT said FROM m)) GROUP BY ALL),
w AS (SELECT said, tf.token, (1 + ln(tf)) * coalesce(idf, other) AS x FROM tf LEFT JOIN idf USING (token), o),
z AS (SELECT said, sqrt(sum(x * x)) AS size FROM w GROUP BY said),
c AS (SELECT said, license, round(sum(w.x * v.x) / any_value(size), 6) AS score FROM w JOIN v USING (token) JOIN z USING (said) GROUP BY said, t, license),
k AS (SELECT said, max({{'score': score, 'license': license}}) AS b FROM c WHERE score >= {THRESHOLD} GROUP BY said),
e AS (SELECT rid, path, b.score AS score, b.license AS license, -spot AS spot FROM m JOIN k USING (said)
  UNION ALL SELECT rid, path, 1.0, unnest(regexp_extract_all(raw, '{SPDX}', 1)), -{OPENING} FROM d),
own AS (SELECT rid, path, max({{'score': score, 'license': license, 'spot': spot}}) AS o FROM e GROUP BY rid, path),
own2 AS (SELECT rid, path, o.license AS own_license, o.score AS own_score,
  path IS NOT NULL AND (o.spot > -{OPENING} OR regexp_matches(path, '{FILE_NAMES.replace("(?i)", "")}', 'i')) AS is_license_file FROM own),
f AS (SELECT {dir_('path')} AS up, min({{'path': path, 'license': own_license}}).license AS license
  FROM own2 WHERE is_license_file GROUP BY 1),
q AS (SELECT d.*, {dir_('path')} AS dir FROM d),
a AS (SELECT q.rid, max({{'n': length(up), 'up': up, 'license': f.license}}) AS x
  FROM q JOIN f ON up = '' OR up = dir OR starts_with(dir, up || '/') GROUP BY q.rid)
SELECT q.doc_id, q.path, own_license, own_score, coalesce(is_license_file, false) AS is_license_file,
  coalesce(own_license, x.license) AS license, CASE WHEN own_license IS NULL THEN x.up END AS inherited_from
FROM q LEFT JOIN own2 USING (rid) LEFT JOIN a USING (rid)
"""
