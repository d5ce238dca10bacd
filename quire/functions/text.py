"""Text functions: Column in, Column out, all inside Catalyst. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import lexicon as lx


def free_name(columns: Sequence[str], stem: str) -> str:
    """``stem`` with underscores before it until none of ``columns`` has the name, whatever its case."""
    name, taken = f"__{stem}", {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _s(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def decode_utf8(content) -> Column:
    """Bytes as text; bytes that aren't UTF-8 are left out, whatever else the file holds."""
    t = (F.col(content) if isinstance(content, str) else content).cast("string")
    return F.when(F.is_valid_utf8(t), t).otherwise(F.replace(F.make_valid_utf8(t), F.lit("\ufffd"), F.lit("")))


def strip(c) -> Column:
    """Trim white space of any kind."""
    return F.regexp_replace(_s(c), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    t = F.regexp_replace(F.regexp_replace(_s(c), r"\r", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def is_heading(c, structural: str = lx.STRUCTURAL_HEADING, upper: str = lx.UPPER_HEADING) -> Column:
    t = strip(c)
    return t.rlike(structural) | t.rlike(upper)


def norm_id(c) -> Column:
    c = _s(c)
    t = F.btrim(F.regexp_replace(F.when(c == "", "chunk").otherwise(c), r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.substring(F.upper(t), 1, 48)


def _kept(tokens: Column, stopwords: Sequence[str]) -> Column:
    return F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.isin(*stopwords))


def _runs(c, pattern: str) -> Column:
    """What the pattern matches in the lower-cased text. To split at a negated class with letters beyond ASCII takes several times as long."""
    return F.regexp_extract_all(F.lower(_s(c)), F.lit(pattern), F.lit(0))


def tokenize_retrieval(c, stopwords: Sequence[str] = lx.RETRIEVAL_STOPWORDS) -> Column:
    """Lower-case alphanumeric tokens of three or more letters, duplicates kept."""
    return _kept(_runs(c, r"[a-zA-Z0-9À-ÿ]{3,}+"), stopwords)


def tokenize_demo(c, stopwords: Sequence[str] = lx.DEMO_STOPWORDS) -> Column:
    """``tokenize_retrieval`` without the words of an app's menus, for the overlap retriever."""
    return tokenize_retrieval(c, stopwords)


def tokenize_evidence(c, stopwords: Sequence[str] = lx.EVIDENCE_STOPWORDS) -> Column:
    """As ``tokenize_retrieval``, with ``/ . -`` kept inside tokens."""
    return _kept(_runs(c, r"[a-z0-9A-ZÀ-ÿ]++(?:[/.-]++[a-z0-9A-ZÀ-ÿ]++)*+"), stopwords)


def claims(c) -> Column:
    """Sentences and lines of 12 characters or more."""
    parts = F.split(strip(c), r"(?U)(?<=[.!?])\s+|\n+")
    return F.transform(F.filter(parts, lambda x: F.length(strip(x)) >= 12), lambda x: F.btrim(x, F.lit(" -•\t")))


def normalize_claim(c, patterns: Sequence[str] = lx.BOILERPLATE) -> Column:
    return strip(reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, strip(c)))


def host(c) -> Column:
    return F.lower(F.regexp_extract(_s(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def is_official_url(c, domains: Sequence[str] = lx.OFFICIAL_DOMAINS) -> Column:
    h = host(c)
    return reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in domains])


def any_match(c, patterns: Sequence[str]) -> Column:
    """Any pattern is found in the lower-cased text."""
    t = F.lower(_s(c))
    return reduce(lambda a, b: a | b, [t.rlike("(?U)" + p) for p in patterns])


def any_contains(c, marks: Sequence[str] = lx.REFUSALS) -> Column:
    t = F.lower(_s(c))
    return reduce(lambda a, b: a | b, [t.contains(m) for m in marks])


def _plain(c) -> Column:
    return F.regexp_replace(F.lower(_s(c)), r"[*_`]+", "")


def declares_insufficient(c) -> Column:
    t = _plain(c)
    return (
        t.contains("tidak tersedia dalam konteks")
        | t.contains("tidak tersedia dalam dokumen")
        | t.contains("tidak tercantum dalam cuplikan")
        | (t.contains("tidak tersedia") & t.contains("konteks resmi"))
        | (t.contains("konteks resmi yang tersedia") & t.contains("tidak"))
    )


def is_neutral(c) -> Column:
    t = _plain(c)
    return t.contains("informasi lebih lanjut") & (t.contains("situs resmi") | t.contains("layanan pelanggan") | t.contains("hubungi"))


def numeric_tokens(c, pattern: str = lx.NUMBERS) -> Column:
    return F.regexp_extract_all(F.lower(_s(c)), F.lit("(?U)" + pattern), F.lit(0))


def evidence_text(title, section, subsection, text, content) -> Column:
    return F.concat_ws(" ", *[_s(c) for c in (title, section, subsection, text, content)])


def search_text(source, title, section, subsection, content, text) -> Column:
    return F.concat_ws(" ", *[_s(c) for c in (source, title, section, subsection, content, text)])


def expand_query(c, rules: Sequence[tuple[str, str]] = lx.QUERY_EXPANSIONS) -> Column:
    q = F.lower(_s(c))
    return F.concat_ws(" ", _s(c), *[F.when(q.rlike("(?U)" + p), F.lit(s)) for p, s in rules])


def approx_tokens(c) -> Column:
    return F.regexp_count(_s(c), F.lit(r"(?U)\w+"))


def clean_line(c) -> Column:
    t = strip(F.regexp_replace(_s(c), r"(?U)\s+", " "))
    return F.when((F.length(t) < 3) | t.rlike(r"(?U)^[\W_]+$"), "").otherwise(t)


def markdown_escape(c) -> Column:
    return F.replace(F.replace(clean_text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def cosine(a, b) -> Column:
    """Cosine in double precision; 0.0 if either norm is 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
