"""HTML main-text extraction by consensus container paths of each host."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

#: Fixed lists: element kinds of HTML, and names that mark furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe noembed noframes xmp title svg math canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
FURNITURE = frozenset("aside button dialog footer form head header label legend menu nav select option".split())
NEVER = frozenset("html body main article".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "contentinfo complementary cookie cookies disclaimer discussion disqus footer form gdpr header hidden login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification overlay pager paginate pagination popup print promo promoted "
    "promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets alert aside".split()
)
#: Marks that begin names of subject matter too, such as share-price. Followed by a word that is neither a mark nor a
#: helper they count only if half of the element's text is in links.
DOUBTED = frozenset(
    "alert banner disclaimer discussion form header hidden login menu notice overlay print promotion recommended related reply "
    "respond search share sharing social sponsor subscription widget widgets".split()
)
HELPERS = frozenset(
    "area bar block body bottom box button buttons center col column container content global group holder icons inner item items "
    "left link links list main outer panel posts right row section site slot title top unit wrap wrapper zone".split()
)
OF_ARTICLE = frozenset("article entry post story page content".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div article section main body td th tr tbody thead tfoot select".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?=[^a-zA-Z])[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A winning path inside the page's own best container counts only if it holds this share of that container's text.
LEAST_SHARE = 0.8
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("blank", "doubt", "good", "bad", "path", "tag", "depth")

    def __init__(self, tag, path, blank, doubt, depth):
        self.tag, self.path, self.blank, self.doubt, self.depth = tag, path, blank, doubt, depth
        self.good = self.bad = 0


def _open(tag: str, attrs: str, parent: _Node | None) -> _Node:
    a = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
    names = " ".join(a.get("class", "").split())
    kinds = sorted({re.sub(r"\d+", "", x) for x in names.split()} - {""})
    step = ".".join([tag, *kinds])
    blank, doubt = bool(parent and parent.blank) or tag in FURNITURE, False
    if not blank and a and tag not in NEVER:
        for value in (*names.split(), a.get("id", ""), a.get("role", "")):
            parts = [x.lower() for x in _PART.findall(value)]
            marks = MARKS.intersection(parts)
            if marks and not {"no", "has", "with", "without"} & set(parts) and not ("header" in parts and OF_ARTICLE & set(parts)):
                sure = not marks <= DOUBTED or parts[-1] in MARKS or parts[-1] in HELPERS
                blank, doubt = blank or sure, doubt or not sure
        blank = blank or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDE.search(a.get("style", "")))
    return _Node(tag, f"{parent.path}>{step}" if parent else step, blank, doubt and not blank, parent.depth + 1 if parent else 0)


def parse_blocks(page: str) -> tuple[list[tuple[str, tuple]], list[_Node]]:
    """(text, open containers) of every block of text outside furniture, and all containers."""
    found: list[tuple[str, int, bool, tuple]] = []
    stack: list[_Node] = []
    nodes: list[_Node] = []
    buf: list[str] = []
    links = 0
    anchors = 0

    def flush():
        nonlocal links
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                inside = tuple(n for n in stack if (n.tag in CONTAINER or n.doubt) and not n.blank)
                found.append((text, min(links, len(text)), bool(stack) and stack[-1].blank, inside))
        links = 0

    def close(upto: int):
        flush()
        del stack[upto:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
            if anchors:
                links += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                buf.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                flush()
            elif tag in BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    flush()
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        if stack[i].blank:
                            flush()
                        del stack[i]
                        break
                    if stack[i].tag in BLOCK:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not m[0].rstrip(">").endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = end.start() if end else size
                if end:
                    gt = page.find(">", at)
                    at = gt + 1 if gt >= 0 else size
            continue
        if tag == "br" or tag in VOID:
            if tag == "hr":
                flush()
            buf.append(" ")
            continue
        if tag == "a":
            anchors += 1
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in CLOSES.get(tag, ()):
                    close(i)
                    if tag != "tr":
                        break
                elif stack[i].tag in SCOPE and stack[i].tag not in CLOSES.get(tag, ()):
                    break
            if tag in ("html", "body") and any(n.tag == tag for n in stack):
                continue
            if tag == "body":
                stack[:] = [n for n in stack if n.tag == "html"]
        else:
            node = _open(tag, m[3], stack[-1] if stack else None)
            if not node.blank or (stack and stack[-1].blank):
                # formatting elements are no part of paths and leave no trace
                continue
            flush()
            stack.append(node)
            continue
        node = _open(tag, m[3], stack[-1] if stack else None)
        stack.append(node)
        if tag in CONTAINER and not node.blank:
            nodes.append(node)
        anchors = 0
    flush()
    return _weigh(found), nodes


def _weigh(found: list[tuple[str, int, bool, tuple]]) -> list[tuple[str, tuple]]:
    """(text, open containers) of the blocks outside furniture, after counting each container's text and furniture.

    ``found`` has (text, characters in links, whether in sure furniture, open containers and doubtful elements).
    """
    size: dict[_Node, list[int]] = {}
    for text, links, _, inside in found:
        for n in inside:
            if n.doubt:
                got = size.setdefault(n, [0, 0])
                got[0] += len(text)
                got[1] += links
    linked = {n for n, (chars, links) in size.items() if 2 * links >= chars}
    blocks = []
    for text, links, blank, inside in found:
        blank = blank or not linked.isdisjoint(inside)
        bad = len(text) if blank else links
        for n in inside:
            n.good += len(text) - bad
            n.bad += bad
        if not blank:
            blocks.append((text, inside))
    return blocks


def _worth(n: _Node) -> float:
    """Text less links and furniture; a little more for elements made to hold the article."""
    return (n.good - 2 * n.bad) * (1.1 if n.tag in ("article", "main") else 1.0)


def best_path(page: str) -> tuple[str, float] | None:
    """Path and score of the page's best container; the deepest of equal ones."""
    _, nodes = parse_blocks(page)
    best = max(nodes, key=lambda n: (_worth(n), n.depth), default=None)
    return (best.path, _worth(best)) if best is not None and best.good > 0 else None


def extract_text(page: str, paths: list[str]) -> str:
    """Blocks under the first of ``paths`` that the page has, and what the page's own best container adds to them.

    A path that lies within that container narrows it only if it holds ``LEAST_SHARE`` of its text, so an article in several parts is not
    cut to one of them. A path beside it adds to it, since both are where articles of the host are; one around it takes its place.
    """
    blocks, nodes = parse_blocks(page)
    best = max(nodes, key=lambda n: (_worth(n), n.depth), default=None)
    if best is None or best.good <= 0:
        return "\n".join(t for t, _ in blocks)
    own = [best in inside for _, inside in blocks]
    whole = sum(len(t) for (t, _), x in zip(blocks, own) if x)
    for path in paths:
        won = [any(n.path == path for n in inside) for _, inside in blocks]
        if any(won):
            held = sum(len(t) for (t, _), x, y in zip(blocks, own, won) if x and y)
            if held < LEAST_SHARE * whole:
                won = [x or y for x, y in zip(own, won)]
            return "\n".join(t for (t, _), x in zip(blocks, won) if x)
    return "\n".join(t for (t, _), x in zip(blocks, own) if x)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = 0.05) -> DataFrame:
    """(host, paths): container paths with ``least`` of a host's votes or more, most votes first.

    Each page votes for the path of its best container. Such paths are at most 1 / least for a host.
    """

    def vote(batches):
        for b in batches:
            got = [best_path(x) if x else None for x in b.column(1).to_pylist()]
            rows = [(h, *g) for h, g in zip(b.column(0).to_pylist(), got) if g]
            h, p, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(s, pa.float64())], names=["host", "path", "score"])

    votes = pages.select(_host(url_col).alias("host"), F.col(html_col)).mapInArrow(vote, "host string, path string, score double")
    per = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("s"))
    all_votes = per.groupBy("host").agg(F.sum("n").alias("total"))
    kept = per.join(all_votes, "host").where(F.col("n") >= least * F.col("total"))
    ranked = F.sort_array(F.collect_list(F.struct("n", "s", "path")), asc=False)
    return kept.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every page, by the winning paths of its host.

    Blocks are in page order, one a line, white space folded, references decoded. A page that
    has none of the paths falls back on its own best container, and one that has more outside the path than in it keeps both. Null or empty html gives an
    empty text; pages without a host in their url form one host; repeated rows are kept; other
    columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    p = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    paths = scratch.table(host_paths(p, url_col, html_col))

    def run(batches):
        for b in batches:
            text = [extract_text(x, w or []) if x else "" for x, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=[id_col, url_col, "text"])

    kind = dict(p.dtypes)
    joined = p.withColumn("host", _host(url_col)).join(paths, "host", "left").select(id_col, url_col, html_col, "paths")
    return joined.mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string")
