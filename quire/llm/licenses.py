"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch


@dataclass(frozen=True)
class Template:
    """A notice: its licence, the terms a passage must and must not hold to be that licence, and its text."""

    license_id: str
    must: tuple[str, ...]
    never: tuple[str, ...]
    text: str


# Notices, headers and short full texts of widely used public licences, as their authors publish them.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR '
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
)
_APACHE_END = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)


def _gnu(name: str, version: str, what: str = "program") -> tuple[str, str]:
    """The two parts of the notice that the GNU licences ask for."""
    about = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    rest = (
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see http://www.gnu.org/licenses/"
    )
    return about, about + rest


def _family(license_id: str, must: tuple[str, ...], never: tuple[str, ...], *texts: str) -> list[Template]:
    return [Template(license_id, must, never, t) for t in texts]


_LICENSED = "This work is licensed under the"
TEMPLATES: tuple[Template, ...] = (
    *_family("AGPL-3.0", ("license", "affero", "3"), (), *_gnu("Affero General Public License", "3"), f"{_LICENSED} GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *_family("Apache-2.0", ("license", "apache", "2.0"), (), "Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE + _APACHE_END, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *_family("BSD-2-Clause", ("redistribution",), ("endorse", "neither"), _BSD, _BSD + _BSD_END),
    *_family("BSD-2-Clause", ("license", "bsd", "2-clause"), (), "Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"),
    *_family("BSD-3-Clause", ("redistribution", "endorse"), (), _BSD + _BSD_NAME, _BSD + _BSD_NAME + _BSD_END),
    *_family("BSD-3-Clause", ("license", "bsd", "3-clause"), (), "Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"),
    *_family("BSD-3-Clause", ("license", "bsd-style"), (), "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *_family("CC-BY-4.0", ("license", "attribution", "4.0"), ("sharealike", "share-alike", "attribution-sharealike", "noncommercial", "attribution-noncommercial", "noderivatives"), f"{_LICENSED} Creative Commons Attribution 4.0 International License."),
    *_family("CC-BY-SA-4.0", ("license", "attribution-sharealike", "4.0"), (), f"{_LICENSED} Creative Commons Attribution-ShareAlike 4.0 International License."),
    *_family("CC-BY-NC-4.0", ("license", "attribution-noncommercial", "4.0"), (), f"{_LICENSED} Creative Commons Attribution-NonCommercial 4.0 International License."),
    *_family("CC0-1.0", ("domain", "cc0"), (), "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *_family("EPL-2.0", ("license", "eclipse", "2.0"), (), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.", "Eclipse Public License - v 2.0"),
    *_family("GPL-2.0", ("license", "general", "2"), ("lesser", "library", "affero", "3"), *_gnu("General Public License", "2"), f"{_LICENSED} GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    *_family("GPL-3.0", ("license", "general", "3"), ("lesser", "library", "affero", "2"), *_gnu("General Public License", "3"), f"{_LICENSED} GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    *_family("ISC", ("permission", "fee"), (), _ISC, _ISC + _ISC_END),
    *_family("ISC", ("license", "isc"), (), "Licensed under the ISC License.", "ISC License"),
    *_family("LGPL-2.1", ("license", "lesser", "2.1"), (), *_gnu("Lesser General Public License", "2.1", "library"), f"{_LICENSED} GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    *_family("LGPL-3.0", ("license", "lesser", "3"), ("2.1",), *_gnu("Lesser General Public License", "3", "library"), f"{_LICENSED} GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    *_family("MIT", ("permission", "sublicense"), (), _MIT, _MIT + _MIT_END),
    *_family("MIT", ("license", "mit"), (), "Released under the MIT License.", "The MIT License (MIT)"),
    *_family("MPL-2.0", ("license", "mozilla", "2.0"), (), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    *_family("Unlicense", ("domain", "unencumbered"), (), _UNLICENSE),
)
#: Every template demands one of the terms license, permission, redistribution and domain, so a passage without these resembles none.
CUES = r"(?i)license|permission|redistribution|domain"
#: A passage that says so of the work is no notice.
NEGATED = r"(?i)\b(?:not|never|no longer)\s+(?:[a-z]+\s+){0,3}(?:licensed|released|distributed|published|available|covered)\s+(?:under|by)\b"
#: An expression of identifiers; what follows WITH is an exception and no licence.
DECLARED = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
EXCEPTION, IDENTIFIER, OPERATOR = r"(?i)\bwith[ \t]+[A-Za-z0-9.-]+", r"[A-Za-z0-9][A-Za-z0-9.+-]*", r"(?i)^(?:and|or)$"
#: What an identifier says of versions, which the templates' identifiers leave out.
VERSIONS = r"(?i)(?:-only|-or-later|\+)$"
NOT_TERM = r"[^a-z0-9.+-]+"
#: What begins a line of comment, and what ends one.
COMMENT = r"[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|<!--|\.\.)"
#: Weight of a term that no template has.
OTHER = 1.0


def _terms(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), NOT_TERM), lambda x: F.btrim(x, F.lit(".+-"))), lambda x: x != "")


def _passages(text: Column) -> Column:
    """The whole text, its blocks of comment, its paragraphs and its lines with a cue, without marks of comment."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?m)((?:^{COMMENT}[^\n]*(?:\n|$))+)"), F.lit(1))
    paragraphs = F.split(text, r"\n(?:[ \t]*\n)+")
    lines = F.split(text, r"\n")
    every = F.filter(F.concat(F.array(text), blocks, paragraphs, lines), lambda x: x.rlike(CUES) & ~x.rlike(NEGATED))
    return F.array_distinct(F.transform(every, lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?m)^{COMMENT}+", " "), r"\s+", " ")))


def _declared(text: Column) -> Column:
    """Identifiers of the text's SPDX expressions, those of templates in their spelling."""
    known = F.create_map(*[F.lit(x) for i in sorted({t.license_id for t in TEMPLATES}) for x in (i.lower(), i)])
    expressions = F.transform(F.regexp_extract_all(text, F.lit(DECLARED), F.lit(1)), lambda x: F.regexp_extract_all(F.regexp_replace(x, EXCEPTION, ""), F.lit(IDENTIFIER), F.lit(0)))
    names = F.filter(F.flatten(expressions), lambda x: ~x.rlike(OPERATOR))
    plain = F.transform(names, lambda x: F.regexp_replace(x, VERSIONS, ""))
    return F.array_distinct(F.transform(plain, lambda x: F.coalesce(known[F.lower(x)], x)))


def template_terms() -> list[tuple[int, str, str, int, bool, bool]]:
    """(t, license_id, term, tf, must, never) of each template's terms, and of those it forbids, with tf 0."""
    import re

    out = []
    for i, t in enumerate(TEMPLATES):
        terms = [x.strip(".+-") for x in re.split(NOT_TERM, t.text.lower())]
        tf = {x: terms.count(x) for x in terms if x}
        out += [(i, t.license_id, x, n, x in t.must, False) for x, n in tf.items()]
        out += [(i, t.license_id, x, 0, False, True) for x in t.never]
    return out


def scan_notices(files: DataFrame, key: str, text_col: str = "text", min_score: float = 0.6, min_margin: float = 0.01) -> DataFrame:
    """(key, license_id, score, licenses) of each file that declares a licence or resembles a template.

    Identifiers of SPDX-License-Identifier lines count as they are, with score 1; the smallest is the license_id. Without one it is the
    best template's. ``licenses`` has all that are declared or that a passage resembles, in alphabetical order. A passage that says the
    work is not under a licence is none. A file's passages are its whole text, its blocks of comment, its paragraphs and its lines, so a header is one
    however long the file is. Passages and templates are vectors of term counts times ln((1 + N) / (1 + df)) + 1,
    with N and df over the passages of all files that hold a cue; terms of no template weigh ``OTHER``. A template counts only if the passage holds all
    terms that its licence demands, such as the version, and none that it forbids, such as lesser. Every licence
    demands a cue, so passages without one are left out and lose nothing. A passage that resembles another licence
    within ``min_margin`` is told by neither. Scores are rounded to 6 places; ties between passages go to
    the smaller license_id. Equal keys are one file.
    """
    scratch, spark = Scratch(files.sparkSession), files.sparkSession
    cued = files.where(F.col(text_col).rlike(CUES)).select(F.col(key).alias("k"), F.col(text_col).alias("t"))
    passages = cued.select("k", F.explode(_passages(F.col("t"))).alias("p")).select("k", F.md5("p").alias("m"), "p").dropDuplicates(["k", "m"])
    tf = passages.select("k", "m", F.explode(_terms(F.col("p"))).alias("term")).groupBy("k", "m", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = scratch.table(tf)
    n = tf.select("k", "m").distinct().count()
    # the templates and their terms are fixed and few, so they are broadcast: a word that every text has is no key of a shuffle
    given = spark.createDataFrame(template_terms(), "t int, license_id string, term string, count int, must boolean, never boolean")
    vocabulary = F.broadcast(given.select("term").distinct())
    df = scratch.table(tf.join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1
    weighed = scratch.table(given.join(df, "term", "left").withColumn("idf", idf))
    norm = weighed.groupBy("t").agg(F.sqrt(F.sum(F.pow(F.col("count") * F.col("idf"), F.lit(2.0)))).alias("norm"))
    template = scratch.table(weighed.join(norm, "t").select("t", "license_id", "term", "must", "never", (F.col("count") * F.col("idf") / F.col("norm")).alias("y")))
    asked = template.groupBy("t").agg(F.count_if("must").alias("asked"))
    own = tf.join(F.broadcast(weighed.select("term", "idf").distinct()), "term", "left")
    own = own.select("k", "m", "term", (F.col("tf") * F.coalesce("idf", F.lit(OTHER))).alias("x"), F.col("idf").isNotNull().alias("known"))
    size = own.groupBy("k", "m").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dot = (
        own.where("known")
        .join(F.broadcast(template), "term")
        .groupBy("k", "m", "t", "license_id")
        .agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count_if("must").alias("held"), F.count_if("never").alias("barred"))
        .join(F.broadcast(asked), "t")
        .where("held = asked AND barred = 0")
        .join(size, ["k", "m"])
    )
    score = F.round(F.least(F.lit(1.0), F.max(F.col("dot") / F.col("size"))), 6)
    by = dot.groupBy("k", "m", "license_id").agg((-score).alias("s"))
    # at most one row for each licence
    ranked = by.groupBy("k", "m").agg(F.sort_array(F.collect_list(F.struct("s", "license_id"))).alias("r"))
    best, second = F.col("r")[0], F.get("r", F.lit(1))
    sure = (best["s"] <= -min_score) & (second.isNull() | (second["s"] - best["s"] >= min_margin))
    told = ranked.where(sure).select("k", F.lit(1).alias("kind"), best["s"].alias("s"), best["license_id"].alias("l"))
    declared = cued.select("k", F.lit(0).alias("kind"), F.lit(-1.0).alias("s"), F.explode(_declared(F.col("t"))).alias("l"))
    per = told.unionByName(declared).groupBy("k").agg(F.min(F.struct("kind", "s", "l")).alias("b"), F.array_sort(F.collect_set("l")).alias("licenses"))
    return per.select(F.col("k").alias(key), F.col("b.l").alias("license_id"), (-F.col("b.s")).alias("score"), "licenses")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit_licenses(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Fill license_id of ``files(path, license_id, score, licenses, is_license_file, ...)`` from the nearest ancestor directory.

    Adds origin (``own``, ``inherited`` or ``none``) and license_path. A file's own licence
    wins; else the licence file in its directory or the nearest one above it counts; of
    several in one directory the one of highest score, then smallest path. Directories are
    resolved once each, however many files they hold. A null path has no directory.
    """
    f = files.withColumn("__dir", _parent(F.col(path_col)))
    held = (
        f.where(F.col("is_license_file") & F.col("license_id").isNotNull() & F.col("__dir").isNotNull())
        .groupBy(F.col("__dir").alias("up"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(path_col).alias("p"), F.col("license_id").alias("l"))).alias("b"))
    )
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = f.where(F.col("__dir").isNotNull()).select("__dir").distinct()
    near = (
        dirs.select("__dir", F.posexplode(above).alias("depth", "up"))
        .join(held, "up")
        .groupBy("__dir")
        .agg(F.max_by("b", "depth").alias("b"))
    )
    out = f.join(near, "__dir", "left")
    own, got = F.col("license_id").isNotNull(), F.col("b").isNotNull()
    return out.withColumns(
        {
            "origin": F.when(own, "own").when(got, "inherited").otherwise("none"),
            "license_path": F.when(own, F.col(path_col)).otherwise(F.col("b.p")),
            "license_id": F.coalesce("license_id", F.col("b.l")),
            "licenses": F.when(own, F.col("licenses")).when(got, F.array("b.l")),
            "score": F.when(own, F.col("score")).otherwise(-F.col("b.s")),
        }
    ).drop("__dir", "b")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", license_file_pattern: str = r"(?i)(^|/)(licen[sc]e|copying)(\.[a-z]+)?$", min_score: float = 0.6) -> DataFrame:
    """Own and inherited licences of ``files(path, text, ...)``: all rows, with license_id, score, licenses, origin, license_path.

    Null and empty texts have no licence of their own; files with a null path are only scanned
    if another column is given as key to ``scan_notices``; repeated rows are kept; columns of the
    added names are replaced; an empty table gives no rows.
    """
    files = files.drop("license_id", "score", "licenses", "origin", "license_path", "is_license_file")
    own = scan_notices(files.where(F.col(path_col).isNotNull()), path_col, text_col, min_score)
    named = F.coalesce(F.col(path_col).rlike(license_file_pattern), F.lit(False))
    return inherit_licenses(files.join(own, path_col, "left").withColumn("is_license_file", named), path_col).drop("is_license_file")
