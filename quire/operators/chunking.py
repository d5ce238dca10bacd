"""Hierarchical chunking: sections by headings, overlapping word windows, chunk records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lexicon as lx
from quire.functions import text as tx


def section_array(text, structural: str = lx.STRUCTURAL_HEADING, upper: str = lx.UPPER_HEADING) -> Column:
    """Array of (section, body): lines under each heading; a heading without lines goes.

    Sections are slices between the places of headings, so the cost is in proportion to a text's lines.
    """
    lines = F.filter(F.transform(F.split(tx.clean_text(text), r"\n"), tx.strip), lambda x: x != "")

    def bind(v, f):
        return F.transform(F.array(v), f)[0]

    def cut(ls, heads):
        starts, ends = F.concat(F.array(F.lit(-1)), heads), F.concat(heads, F.array(F.size(ls)))
        found = F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(
                F.when(s < 0, "General").otherwise(F.substring(F.get(ls, s), 1, 140)).alias("section"),
                F.when(e - s > 1, F.array_join(F.slice(ls, s + 2, e - s - 1), "\n")).alias("body"),
            ),
        )
        return F.filter(found, lambda x: x["body"].isNotNull())

    def placed(ls):
        heads = F.array_compact(F.transform(ls, lambda x, i: F.when(tx.is_heading(x, structural, upper), i)))
        return bind(heads, lambda h: cut(ls, h))

    return bind(lines, placed)


def sections(docs: DataFrame, key: str, text: str, structural: str = lx.STRUCTURAL_HEADING, upper: str = lx.UPPER_HEADING) -> DataFrame:
    """(key, section_no, section, body) of every section, without a shuffle."""
    found = docs.select(key, F.posexplode(section_array(text, structural, upper)).alias("no", "s"))
    return found.select(key, (F.col("no") + 1).alias("section_no"), "s.section", "s.body")


def word_windows(text, max_words: int = 220, overlap: int = 40) -> Column:
    """Array of windows; a text of at most ``max_words`` words is returned unchanged, a blank one gives none."""
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least 0 and less than max_words")
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    step = max_words - overlap
    last = (F.ceil((F.size(words) - max_words) / F.lit(step)) * step).cast("int")
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, max_words), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= max_words, F.array(t)).otherwise(many)


def _nonempty(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


#: Columns of an extracted element; absent ones count as null.
ELEMENT = {
    "doc_id": "string", "title": "string", "institution": "string", "source_type": "string", "source_url": "string", "version": "string",
    "page": "int", "section": "string", "chunk_type": "string", "table_index": "int", "text": "string", "content": "string", "doc_ord": "long",
}


def build_chunks(elements: DataFrame, max_words: int = 220, overlap: int = 40, keep: Sequence[str] = ()) -> DataFrame:
    """One row per chunk. ``doc_ord`` (from 1) is the element's place in its file and part of chunk ids.

    Columns in ``keep`` go from each element to its chunks; no chunk has a column of such a name.

    Elements are judged row by row: a repeated ordinal repeats an id, a null one reads "null" in it, and neither loses or mixes text.
    """
    e = elements.select(*[(F.col(c) if c in elements.columns else F.lit(None)).cast(t).alias(c) for c, t in ELEMENT.items()], *keep)
    e = e.withColumns(
        {
            "title": F.coalesce(_nonempty("title"), "doc_id"),
            "source": F.coalesce(_nonempty("title"), _nonempty("doc_id"), _nonempty("source_url"), F.lit("unknown_source")),
            "chunk_type": F.coalesce(_nonempty("chunk_type"), F.lit("text")),
            "body": F.coalesce(_nonempty("content"), "text", F.lit("")),
            "base": F.coalesce(_nonempty("section"), F.when(F.col("page") != 0, F.format_string("page_%d", "page")), F.lit("General")),
        }
    )
    whole = (F.col("chunk_type") == "table") | _nonempty("section").isNotNull()
    own = F.array(F.struct(F.coalesce(_nonempty("section"), "base").alias("section"), F.col("body").alias("body")))
    both = e.select("*", F.posexplode(F.when(whole, own).otherwise(section_array("body"))).alias("no", "s"))
    both = both.withColumns({"section_no": F.col("no") + 1, "found": F.col("s.section"), "body": F.col("s.body")}).drop("no", "s")
    plain = F.col("found") == "General"
    label = F.when(plain, F.col("base")).otherwise(F.col("found"))
    both = both.withColumns({"own": F.col("section"), "subtitle": F.when(~plain, F.col("found"))}).withColumn("section", label)
    parts = both.select("*", F.posexplode(word_windows("body", max_words, overlap)).alias("part", "piece"))
    short = _nonempty("own").isNotNull() & F.col("page").isNull() & (F.col("part") == 0)
    name = F.concat(F.coalesce("doc_id", F.lit("None")), F.lit("_"), tx.norm_id("section"), F.lit("_"))
    return parts.select(
        F.when(short, F.concat(name, F.format_string("%03d", "doc_ord")))
        .otherwise(F.concat(name, F.format_string("%04d_%02d", "doc_ord", F.col("part") + 1)))
        .alias("chunk_id"),
        "doc_ord",
        "section_no",
        (F.col("part") + 1).alias("part_no"),
        "doc_id",
        "source",
        F.struct("page", "section", F.col("subtitle").alias("subsection"), "chunk_type", "table_index").alias("metadata"),
        "chunk_type",
        "table_index",
        "title",
        "subtitle",
        "section",
        F.col("subtitle").alias("subsection"),
        "source_type",
        "institution",
        "source_url",
        "version",
        "page",
        F.col("page").alias("page_start"),
        F.col("page").alias("page_end"),
        F.struct("title", "section", "subtitle", "page").alias("hierarchy"),
        F.filter(F.array("title", "section", "subtitle"), lambda x: x.isNotNull() & (x != "")).alias("hierarchy_path"),
        F.col("piece").alias("text"),
        F.col("piece").alias("content"),
        tx.approx_tokens("piece").alias("token_count_approx"),
        *keep,
    )


def last_wins(chunks: DataFrame) -> DataFrame:
    """One chunk of each id, the last in corpus order."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("doc_ord"), F.desc("section_no"), F.desc("part_no"))
    return chunks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
