"""Operators on tables of cells (array<array<string>>): cleaning, headers, Markdown and key-value text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lexicon as lx
from quire.functions.text import clean_text, markdown_escape


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in an expression."""
    return F.transform(F.array(value), use)[0]


def _filled(x: Column) -> Column:
    return (x != "") & ~x.rlike(lx.TABLE_NOISE)


def normalize_table(table) -> Column:
    """Clean cells; rows without a cell that holds more than separators go."""
    t = F.coalesce(F.col(table) if isinstance(table, str) else table, F.array().cast("array<array<string>>"))
    rows = F.transform(t, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), clean_text))
    return F.filter(rows, lambda r: F.exists(r, _filled))


def _width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def _numbered(n: Column) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("col_"), i.cast("string")))).otherwise(
        F.array().cast("array<string>")
    )


def infer_headers(rows: Column) -> Column:
    """struct<headers, start> of normalised rows: the first of three rows with enough lettered cells, else col_N."""
    enough = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(_width(rows) / 2).cast("int")))
    lettered = F.filter(
        F.sequence(F.lit(0), F.lit(2)),
        lambda i: F.size(F.filter(F.coalesce(F.get(rows, i), F.array().cast("array<string>")), lambda x: _filled(x) & x.rlike("[A-Za-zÀ-ÿ]"))) >= enough,
    )
    at = F.get(lettered, F.lit(0))
    named = F.transform(F.get(rows, at), lambda x, i: F.when(x == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(F.substring(x, 1, 80)))
    return F.when(at.isNotNull(), F.struct(named.alias("headers"), (at + 1).alias("start"))).otherwise(
        F.struct(_numbered(_width(rows)).alias("headers"), F.lit(0).alias("start"))
    )


def _pad(r: Column, width: Column) -> Column:
    return F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), F.greatest(width, F.lit(1)))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_escape), " | "), F.lit(" |"))


def _markdown(rows: Column) -> Column:
    def body(h):
        width = F.greatest(F.size(h["headers"]), _width(rows))
        extra = F.filter(_numbered(width), lambda x, i: i >= F.size(h["headers"]))
        headers = F.concat(h["headers"], extra)
        data = F.when(h["start"] < F.size(rows), F.slice(rows, h["start"] + 1, F.greatest(F.size(rows) - h["start"], F.lit(1)))).otherwise(rows)
        lines = F.transform(data, lambda r: _line(_pad(r, width)))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(_line(headers), rule), lines), "\n")

    return F.when(F.size(rows) == 0, "").otherwise(_bind(infer_headers(rows), body))


def _key_values(rows: Column) -> Column:
    def body(h):
        data = F.slice(rows, h["start"] + 1, F.greatest(F.size(rows) - h["start"], F.lit(1)))

        def line(r, i):
            pairs = F.zip_with(h["headers"], F.slice(r, F.lit(1), F.size(h["headers"])), lambda k, v: F.when(_filled(F.coalesce(v, F.lit(""))), F.concat(k, F.lit(": "), v)))
            pairs = F.array_compact(pairs)
            return F.when(F.size(pairs) > 0, F.concat(F.lit("Baris "), (i + 1).cast("string"), F.lit(": "), F.array_join(pairs, " | ")))

        return F.when(h["start"] < F.size(rows), F.array_join(F.array_compact(F.transform(data, line)), "\n")).otherwise("")

    return F.when(F.size(rows) == 0, "").otherwise(_bind(infer_headers(rows), body))


def table_to_markdown(table) -> Column:
    return _bind(normalize_table(table), _markdown)


def table_to_text(table) -> Column:
    return _bind(normalize_table(table), _key_values)


def table_to_structured_text(table) -> Column:
    md, kv = table_to_markdown(table), table_to_text(table)
    return clean_text(F.concat_ws("\n", F.when(md != "", md), F.when(kv != "", kv)))


def dedup_tables(tables: DataFrame, by: list[str], index: str = "table_index", content: str = "content") -> DataFrame:
    """First of the tables of a page whose contents agree but for case and white space; empty ones go."""
    key = F.regexp_replace(F.lower(content), r"(?U)\s+", " ")
    w = Window.partitionBy(*by, "__key").orderBy(index)
    t = tables.where(F.coalesce(F.col(content), F.lit("")) != "").withColumn("__key", key)
    return t.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__key")
