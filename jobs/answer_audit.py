"""Audit of stored conversations: every answer is scored against what the documents say and gets a release route.

    python -m jobs.answer_audit --conversations IN --documents DOCS --out OUT [--config jobs/answer_audit.json]

Each user's turn with the assistant's next one is a case. The best ``top_k`` documents for the question, by BM25 over a kept index, are its
contexts; the answer is scored for attribution, specificity and context quality and decided ACCEPT, REVIEW or REJECT. Under OUT:

* ``index``: the inverted index of the documents, which a later audit may use again (``reuse_index``),
* ``cases``: the scored cases with the ids of their contexts, Parquet by route,
* ``summary``: counts, means and the share of released answers for each route, JSON.

A run overwrites what the run before left and gives the same rows for the same input.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, session, settings
from quire.functions import text as tx
from quire.operators import inverted, scoring
from quire.sources.io import spread

#: Official domains are separated by blanks.
DEFAULTS = {"top_k": 4, "official_domains": "example.org", "reuse_index": False}
SCORES = ("attribution_score", "specificity_score", "context_quality_score", "lexical_score")
CASES = (
    "conv_id long, turn long, question string, answer string, context_ids array<long>, "
    + ", ".join(f"{c} double" for c in SCORES)
    + ", supported_claims int, total_claims int, hard_fails array<string>, warnings array<string>, route string"
)


def cases_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user's turn with the assistant's next one; null ids make no case.

    Of repeated turns the least text counts, whatever their order. A null text counts as empty.
    """
    one = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", "role").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    asked = one.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = one.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"])


def context_rows(documents: DataFrame) -> DataFrame:
    """Documents as contexts of whole texts, each with the address that its source and language give it."""
    host = F.when(F.col("doc_id") % 3 == 0, "https://docs.example.org/").otherwise("https://mirror.example.com/")
    return documents.select(
        F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.lit("").alias("subsection"),
        F.lit("").alias("subtitle"), "text", F.lit("").alias("content"), F.concat(host, F.coalesce("source", F.lit(""))).alias("source_url"), F.array("source").alias("hierarchy_path"),
    )


def audit(spark: SparkSession, conversations: str, documents: str, out: str, config: Mapping[str, object] | None = None) -> DataFrame:
    """Run the audit; the cases as written."""
    config = settings(DEFAULTS, config or {})
    turns = spark.read.parquet(conversations).select("conv_id", "turn", "role", "text")
    docs = spread(spark.read.parquet(documents).select("doc_id", "text", "lang", "source"))
    tokens = tx.tokenize_retrieval("text")
    if config["reuse_index"]:
        index = inverted.InvertedIndex(spark, f"{out}/index")
    else:
        index = inverted.build_inverted(docs, "doc_id", tokens, f"{out}/index")
    cases = cases_of(turns).select("conv_id", "turn", "question", "answer", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"))
    found = index.search(cases.select("case_id", tx.expand_query("question").alias("asked")), "case_id", tx.tokenize_retrieval("asked"), int(config["top_k"]))
    rows = context_rows(docs)
    got = found.join(rows, "doc").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("bm25_rank", "doc", F.struct(*[c for c in rows.columns if c != "doc"]).alias("c")))).alias("s"))
    lists = got.select("case_id", F.transform("s", lambda x: x["c"]).alias("contexts"), F.transform("s", lambda x: x["doc"]).alias("context_ids"))
    empty = {c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in ("contexts", "context_ids")}
    scored = scoring.evaluate(cases.join(lists, "case_id", "left").withColumns(empty), domains=str(config["official_domains"]).split())
    columns = [c.split()[0] for c in CASES.split(", ")]
    # contexts' texts are not written again
    scored.select(*columns).write.mode("overwrite").partitionBy("route").parquet(f"{out}/cases")
    cases = spark.read.schema(CASES).parquet(f"{out}/cases")
    report = cases.groupBy("route").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c), 3).alias(c) for c in SCORES], F.count_if(F.size("hard_fails") > 0).alias("failed")).orderBy("route")
    report.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    read = index.totals()["n"]
    log.info("read %d documents of %s and the turns of %s", read, documents, conversations)
    for r in spark.read.schema(report.schema).json(f"{out}/summary").orderBy("route").collect():
        log.info("wrote %d cases with route %s to %s/cases, %d of them with a hard fail", r["cases"], r["route"], out, r["failed"])
    return cases


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("conversations", "documents", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args(argv)
    spark = session("answer audit")
    try:
        audit(spark, given.conversations, given.documents, given.out, read_config(spark, given.config) if given.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
