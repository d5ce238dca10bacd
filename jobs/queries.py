"""The jobs as registered queries, with their SQL: each is run twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answer_audit, knowledge_feed
from quire.plans import catalog
from quire.sources.io import new_folder


def job1_knowledge_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "job1")
    for _ in range(2):
        # a pattern, since a stream of files takes a table that is one file by no other name
        knowledge_feed.feed(spark, f"{sf_dir}/documents*.parquet", f"{root}/out", f"{root}/checkpoint")
    c = knowledge_feed.current_chunks(spark, f"{root}/out")
    return c.select(
        "chunk_id", "doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("part_no").cast("long").alias("part_no"), "lang", "section",
        F.array_join("hierarchy_path", " > ").alias("path"), F.col("token_count_approx").cast("long").alias("n_tokens"), F.md5("text").alias("digest"),
    )


def _job1_sql() -> str:
    sections = catalog.q_sections(catalog.q_lines("text"))
    return rf"""WITH {sections},
x AS (SELECT doc_id, section_no, lang, source, section, body, row_number() OVER (ORDER BY doc_id, section_no) AS rid FROM sec JOIN documents USING (doc_id)),
{catalog.q_windows('x', 'rid', 'body')}
SELECT concat(doc_id, '_', {catalog.Q_NORM}, '_', CASE WHEN doc_id < 10000 THEN lpad(CAST(doc_id AS VARCHAR), 4, '0') ELSE CAST(doc_id AS VARCHAR) END, '_', CASE WHEN part < 100 THEN lpad(CAST(part AS VARCHAR), 2, '0') ELSE CAST(part AS VARCHAR) END) AS chunk_id,
doc_id, section_no, CAST(part AS BIGINT) AS part_no, lang, section, concat(source, ' > ', section, CASE WHEN section <> 'General' THEN ' > ' || section ELSE '' END) AS path,
len(regexp_extract_all(piece, '[\p{{L}}\p{{N}}_]+')) AS n_tokens, md5(piece) AS digest FROM x JOIN win USING (rid)"""


def job2_answer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "job2")
    for _ in range(2):
        cases = answer_audit.audit(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", f"{root}/out")
    return cases.select(
        "conv_id", "turn", "route", "attribution_score", "specificity_score", "context_quality_score", "lexical_score", F.col("total_claims").cast("long").alias("total_claims"),
        F.array_join(F.col("context_ids").cast("array<string>"), ",").alias("contexts"), F.array_join("hard_fails", "|").alias("hard_fails"), F.array_join("warnings", "|").alias("warnings"),
    )


def _job2_sql() -> str:
    expanded = catalog.q_expanded("question")
    asked = """cs AS (SELECT q.conv_id, q.turn, concat(q.conv_id, '-', q.turn) AS k, q.text AS question, a.text AS answer
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""
    return f"""WITH {catalog.Q_TERMS}, {asked},
qt AS (SELECT k, term, count(*) AS qtf FROM (SELECT k, unnest({catalog.q_retrieval(expanded)}) AS term FROM cs) GROUP BY ALL),
sc0 AS (SELECT k, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s FROM qt JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, doc_id) AS pos FROM sc0 QUALIFY pos <= 4),
cx AS (SELECT k, pos, doc_id, source, lang, text AS dtext FROM bm JOIN documents USING (doc_id) WHERE s > 0),
{catalog.q_evaluated('doc_id % 3 = 0')}
SELECT conv_id, turn, route, attribution_score, specificity_score, context_quality_score, lexical_score, total_claims, coalesce(contexts, '') AS contexts, hard_fails, warnings
FROM evaluated LEFT JOIN (SELECT k, string_agg(doc_id, ',' ORDER BY pos) AS contexts FROM cx GROUP BY k) USING (k)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_knowledge_feed": job1_knowledge_feed, "job2_answer_audit": job2_answer_audit}


def oracle_sql() -> dict[str, str]:
    return {"job1_knowledge_feed": _job1_sql(), "job2_answer_audit": _job2_sql()}
