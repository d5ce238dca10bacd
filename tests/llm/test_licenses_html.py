"""Declared licences, negations and several licences of a file; articles in several parts."""

import pytest

from quire.llm.htmltext import extract_pages
from quire.llm.licenses import scan_licenses

NOTICES = {
    "SPDX-License-Identifier: MIT": ("MIT", ["MIT"]),
    "// SPDX-License-Identifier: GPL-2.0-only\nint main() {}": ("GPL-2.0", ["GPL-2.0"]),
    "/* SPDX-License-Identifier: Apache-2.0 */": ("Apache-2.0", ["Apache-2.0"]),
    "# spdx-license-identifier: (mit OR Apache-2.0)\ncode": ("Apache-2.0", ["Apache-2.0", "MIT"]),
    "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause": ("BSD-3-Clause", ["BSD-3-Clause", "GPL-2.0"]),
    "<!-- SPDX-License-Identifier: LGPL-2.1+ -->": ("LGPL-2.1", ["LGPL-2.1"]),
    "# SPDX-License-Identifier: Zlib": ("Zlib", ["Zlib"]),
    "This software is not released under the MIT License.": (None, None),
    "The files are no longer distributed under the Apache License, Version 2.0.": (None, None),
    "This software is released under the MIT License.": ("MIT", ["MIT"]),
    "Released under the MIT License.\n\nSome parts differ.\n\nLicensed under the Apache License, Version 2.0.": ("Apache-2.0", ["Apache-2.0", "MIT"]),
    "Eclipse Public License - v 2.0": ("EPL-2.0", ["EPL-2.0"]),
    "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.": ("CC-BY-NC-4.0", ["CC-BY-NC-4.0"]),
    "This work is licensed under the Creative Commons Attribution 4.0 International License.": ("CC-BY-4.0", ["CC-BY-4.0"]),
    "A licence plate and a domain name.": (None, None),
}


def test_notices(spark):
    texts = list(NOTICES)
    got = scan_licenses(spark.createDataFrame([(f"{i}/f.txt", t, "x") for i, t in enumerate(texts)], "path string, text string, licenses string"))
    rows = {r["path"]: r for r in got.collect()}
    for i, t in enumerate(texts):
        r = rows[f"{i}/f.txt"]
        ids = NOTICES[t][1]
        assert sorted(r["licenses"] or []) == sorted(ids or []), t
        # between notices of equal score the smaller identifier counts; declared ones score 1
        assert r["license_id"] == NOTICES[t][0] or (r["license_id"] in (ids or []) and "SPDX" not in t), t


def page(*parts):
    body = "".join(f'<div class="{c}">' + "".join(f"<p>{p}</p>" for p in ps) + "</div>" for c, ps in parts)
    return f'<html><body><nav><a href="/">Home</a> <a href="/b">More</a></nav><div class="page">{body}</div><footer>All rights</footer></body></html>'


@pytest.mark.parametrize("parts", [2, 3])
def test_articles_in_parts_come_back_whole(spark, parts):
    line = "Sentence {} of the article says a little more than the one before it, at some length."
    plain = [page(("content", [line.format(f"{i}-{j}") for j in range(6)])) for i in range(12)]
    wanted = ["\n".join(line.format(f"{i}-{j}") for j in range(6)) for i in range(12)]
    texts = [["A short introduction of one sentence, which is part of the article too."]] + [[line.format(f"p{k}-{j}") for j in range(3 + k)] for k in range(parts - 1)]
    mixed = page(*zip(["content", "story", "more"], texts))
    rows = [(i, f"https://h.example/{i}", h) for i, h in enumerate([*plain, mixed])]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == wanted
    assert got[12] == "\n".join(x for t in texts for x in t)
