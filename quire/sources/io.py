"""Sources and sinks: JSON lines, CSV catalogues, raw files, thresholds, extraction and download."""

from __future__ import annotations

import io
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib import parse, request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import html, lexicon
from quire.functions.text import clean_text, decode_utf8, host
from quire.operators.tables import dedup_tables, table_to_structured_text

CATALOG_COLUMNS = (
    "doc_id title institution source_type format year version source_url landing_page local_path accessed_at scope officiality risk_scope notes"
).split()
METADATA = "doc_id title institution source_type source_url version accessed_at format year scope".split()


#: Bytes of a scan up to which it may be dealt out anew.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out by rows if its scan is small and has fewer partitions than there are cores.

    A file of one row group is one task's work, whatever the number of partitions. A larger table stays as it is: with
    fewer partitions than cores it still gives every task enough, and a shuffle of it would cost more than idle cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES else df


_LOCAL_ROOT: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a new name under ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(Path(tempfile.mkdtemp(prefix="quire-")).as_uri())
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Declared schema, blank lines skipped, malformed lines raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """JSON lines. With ``order`` the files' names sort as their rows do: reading them one after another gives the order.

    Rows are range-partitioned by ``order``, so however many there are, no task gets them all; equal values stay in one file.
    ``single`` is for reports of few rows.
    """
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order).drop(order)
    (df.coalesce(1) if single else df).write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str, columns=CATALOG_COLUMNS) -> DataFrame:
    """CSV of strings with quoted commas; missing values are empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"').fillna("")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind) of raw files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content", html.file_kind(F.col("content"), F.col("path")).alias("kind"))


def pdf_reader() -> Callable[[bytes], list[tuple[int, str, str | list[list[str | None]]]]]:
    """The first PDF library that is installed, as a function to (page, "text", text) and (page, "table", cells) elements."""
    try:
        import pdfplumber

        def plumber(raw):
            out = []
            with pdfplumber.open(io.BytesIO(raw)) as pdf:
                for n, page in enumerate(pdf.pages, 1):
                    out.append((n, "text", page.extract_text(x_tolerance=1, y_tolerance=3) or ""))
                    tables = page.extract_tables({"vertical_strategy": "lines", "horizontal_strategy": "lines", "intersection_tolerance": 5})
                    out += [(n, "table", t) for t in tables or page.extract_tables() or []]
            return out

        return plumber
    except ImportError:
        pass
    try:
        from pypdf import PdfReader

        return lambda raw: [(n, "text", p.extract_text() or "") for n, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber or pypdf") from e


def extract_documents(catalog: DataFrame, files: DataFrame, reader: Callable | None = None) -> DataFrame:
    """Elements (metadata, page, section, subtitle, chunk_type, table_index, text, content, error) of the catalogue's files.

    ``files(local_path, content, kind)``; missing and empty files are skipped. ``reader`` gives the elements of a PDF as
    ``pdf_reader`` does; the tables of a page become structured text, numbered from 1, without repeated ones. A PDF that cannot be
    read falls back on its HTML or its text and names the error; one file never fails the others. Bytes that aren't UTF-8 are left out.
    """
    joined = catalog.join(files.where(F.length("content") > 0), "local_path")
    columns = [*METADATA, "page", "kind", "no", "raw", "cells", "error"]
    none = {"page": "int", "no": "int", "cells": "array<array<string>>", "error": "string"}
    plain = joined.where(F.col("kind") != "pdf").withColumn("raw", decode_utf8("content")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})

    def pages(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                meta, mine = [getattr(row, c) for c in METADATA], []
                try:
                    seen: dict[int, int] = {}
                    for page, kind, got in (reader or pdf_reader())(bytes(row.content)):
                        if kind == "table":
                            seen[page] = seen.get(page, 0) + 1
                            mine.append((*meta, page, "table", seen[page], None, [[None if x is None else str(x) for x in r or ()] for r in got], None))
                        else:
                            mine.append((*meta, page, "text", None, got, None, None))
                except Exception as e:
                    raw = bytes(row.content).decode("utf-8", "ignore")
                    marked = any(m in raw.lower() for m in ("<html", "<!doctype"))
                    mine = [(*meta, None, "html" if marked else "text", None, raw, None, str(e))]
                # file by file: a batch's tables are not held together
                yield pd.DataFrame(mine, columns=columns).astype({"page": "Int32", "no": "Int32"})

    schema = ", ".join([*(f"{c} string" for c in METADATA), "page int, kind string, no int, raw string, cells array<array<string>>, error string"])
    read = joined.where("kind = 'pdf'").select(*METADATA, "content").mapInPandas(pages, schema)
    each = plain.select(*columns).unionByName(read)
    table = F.col("kind") == "table"
    each = each.withColumn("body", F.when(table, table_to_structured_text("cells")).when(F.col("kind") == "html", html.html_text_dom(F.col("raw"))).otherwise(clean_text(F.col("raw"))))
    each = dedup_tables(each.where(table), ["doc_id", "page"], "no", "body").unionByName(each.where(~table))
    label = F.format_string("Tabel %d", "no")
    section = F.when(table, F.format_string("Tabel %d halaman %d", "no", "page"))
    text = F.when(table, F.concat_ws("\n", section, "body")).otherwise(F.col("body"))
    return each.where("body <> ''").select(
        *METADATA,
        "page",
        section.alias("section"),
        F.when(table, label).alias("subtitle"),
        F.when(table, "table").otherwise("text").alias("chunk_type"),
        F.col("no").alias("table_index"),
        text.alias("text"),
        text.alias("content"),
        "error",
    )


def pdf_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page, text) of extracted elements, tables included."""
    return elements.where("page IS NOT NULL").select("doc_id", "page", F.col("content").alias("text"))


def pick_source(spark: SparkSession, extracted: str, starter: str, schema) -> DataFrame:
    """The extracted documents if there are any, else the starter ones."""
    try:
        df = read_jsonl(spark, extracted, schema)
        if not df.isEmpty():
            return df
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return read_jsonl(spark, starter, schema)


def load_thresholds(path: str | None = None) -> dict[str, float]:
    """Defaults, overridden by known keys of a YAML file of ``name: number`` lines."""
    out = dict(lexicon.THRESHOLDS)
    if path is None:
        return out
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, _, value = line.split("#")[0].partition(":")
        if name.strip() in out and value.strip():
            out[name.strip()] = float(value)
    return out


def fetch(url: str, timeout: int = 60) -> bytes:
    with request.urlopen(request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as reply:
        return reply.read()


def download_missing(catalog: DataFrame, have: DataFrame, get: Callable[[str], bytes] = fetch, pause: float = 1.0, tries: int = 3) -> DataFrame:
    """(local_path, content, status): files of the catalogue that ``have(local_path)`` lacks.

    All files of a host are one task's, which waits ``pause`` seconds between two requests to it, so the host is spared whatever the number of
    tasks; hosts are fetched side by side. A request is tried up to ``tries`` times, each wait twice the one before. A landing page in
    place of a PDF is followed to its first download link. Files that cannot be had have a status that says why.
    """
    want = catalog.join(have, "local_path", "left_anti").select("local_path", "source_url")

    def run(batches):
        last: dict[str, float] = {}

        def ask(url: str) -> bytes:
            at = parse.urlsplit(url or "").netloc
            for n in range(tries):
                time.sleep(max(0.0, last.get(at, 0.0) + pause * 2**n - time.time()))
                try:
                    return get(url)
                except Exception:
                    if n + 1 == tries:
                        raise
                finally:
                    last[at] = time.time()
            raise ValueError("tries must be 1 at least")

        for pdf in batches:
            for path, url in zip(pdf["local_path"], pdf["source_url"]):
                try:
                    raw = ask(url)
                    if path.lower().endswith(".pdf") and not raw.startswith(b"%PDF"):
                        link = html.download_link(url, raw.decode("utf-8", "ignore"))
                        raw = ask(link) if link else raw
                    row = (path, raw, "ok")
                except Exception as e:
                    row = (path, None, f"failed: {e}")
                yield pd.DataFrame([row], columns=["local_path", "content", "status"])

    dealt = want.repartition(4 * want.sparkSession.sparkContext.defaultParallelism, host("source_url"))
    return dealt.mapInPandas(run, "local_path string, content binary, status string")
