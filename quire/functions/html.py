"""HTML functions: file kind, plain text, download links."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import lexicon as lx
from quire.functions.text import clean_text


_HREF = re.compile(r"""(?i)href=["']([^"']+)["']""")


def file_kind(content: Column, path: Column) -> Column:
    """``pdf``, ``html`` or ``text`` by the first 4096 bytes (binary) and the suffix."""
    raw = F.regexp_replace(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"^[ \t\n\r\x0b\f]+", "")
    low = F.lower(raw)
    page = low.startswith("<!doctype") | low.contains("<html") | F.lower(path).rlike(r"\.html?$")
    return F.when(raw.startswith("%PDF"), "pdf").when(page, "html").otherwise("text")


def html_text(c) -> Column:
    """Regular-expression mode: script and style blocks go, each tag becomes a line break, entities stay."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return clean_text(F.regexp_replace(t, r"<[^>]+>", "\n"))


class _Text(HTMLParser):
    SKIP = ("script", "style", "nav", "footer")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(StringType())
def _dom(pages: pd.Series) -> pd.Series:
    def one(p):
        parser = _Text()
        parser.feed(p or "")
        parser.close()
        return "\n".join(parser.parts)

    return pages.map(one)


def html_text_dom(c) -> Column:
    """DOM mode: text nodes outside script, style, nav and footer, one a line, entities decoded."""
    return clean_text(_dom(c))


def first_download_link(c, marks: Sequence[str] = lx.DOWNLOAD_MARKS) -> Column:
    """First href with one of the marks, unresolved; null if none."""
    links = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))
    return F.get(F.filter(links, lambda u: reduce(lambda a, b: a | b, [F.lower(u).contains(m) for m in marks])), F.lit(0))


def download_link(base: str, page: str, marks: Sequence[str] = lx.DOWNLOAD_MARKS) -> str | None:
    """The first link of a page with one of the marks, resolved against the page's address; None if there is none."""
    for link in _HREF.findall(page):
        url = urljoin(base, link)
        if any(m in url.lower() for m in marks):
            return url
    return None
