"""Reports and checks: quality summary, context previews, evaluation-set and package checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.lexicon import ROUTES

METRICS = ("attribution_score", "specificity_score", "context_quality_score")


def quality_summary(results: DataFrame, order: str = "ord", case_id: str = "question_id", routes: Sequence[str] = ROUTES) -> DataFrame:
    """One row: totals, pass rate, counts by route, metric means, failed ids in input order."""
    expected = F.coalesce(F.col("expected_route"), F.lit("")) != ""
    passed = expected & F.coalesce(F.col("pass"), F.lit(False))

    def counts(c):
        pairs = F.array(*[F.struct(F.lit(r).alias("k"), F.count_if(F.col(c) == r).alias("v")) for r in routes])
        return F.map_from_entries(F.filter(pairs, lambda x: x["v"] > 0))

    n = F.count_if(expected)
    failed = F.sort_array(F.collect_list(F.when(expected & ~passed, F.struct(F.col(order).alias("o"), F.col(case_id).alias("c")))))
    return results.agg(
        F.count(F.lit(1)).alias("total_cases"),
        n.alias("expected_cases"),
        F.count_if(passed).alias("passed_cases"),
        F.when(n > 0, F.round(F.count_if(passed) / n, 3)).alias("pass_rate"),
        counts("route").alias("route_counts"),
        counts("expected_route").alias("expected_route_counts"),
        F.create_map(*[x for m in METRICS for x in (F.lit(m), F.round(F.coalesce(F.sum(F.coalesce(m, F.lit(0.0))) / F.greatest(F.count(F.lit(1)), F.lit(1)), F.lit(0.0)), 3))]).alias(
            "metric_averages"
        ),
        F.transform(failed, lambda x: x["c"]).alias("failed_question_ids"),
    )


def context_preview(contexts: Column, length: int = 500) -> Column:
    keep = ("chunk_id", "title", "section", "rrf_score", "bm25_rank", "vector_rank")
    return F.transform(contexts, lambda c: F.struct(*[c[k].alias(k) for k in keep], F.substring(F.coalesce(c["text"], c["content"], F.lit("")), 1, length).alias("text_preview")))


def evalset_violations(cases: DataFrame, required: Sequence[str], key: str = "question_id", routes: Sequence[str] = ROUTES) -> DataFrame:
    """(key, problems) of rows that lack a required value or name an unknown route."""
    lacks = [F.when(F.col(c).isNull() if c in cases.columns else F.lit(True), F.lit(c)) for c in sorted(required)]
    bad = F.when(~F.coalesce(F.col("expected_route").isin(list(routes)), F.lit(False)), F.lit("invalid expected_route"))
    return cases.select(key, F.array_compact(F.array(*lacks, bad)).alias("problems")).where(F.size("problems") > 0)


def dangling_ids(cases: DataFrame, key: str, ids: str, chunks: DataFrame) -> DataFrame:
    """(key, chunk_id) that no chunk has."""
    return cases.select(key, F.explode(ids).alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(key, "chunk_id")


def package_problems(catalog: DataFrame, chunks: DataFrame, cases: DataFrame, least=(8, 15, 20)) -> DataFrame:
    """(check, detail) of everything that is wrong with a package; empty if all is well."""
    out = None
    for name, df, n in zip(("sources", "chunks", "cases"), (catalog, chunks, cases), least):
        few = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n).select(F.lit(f"too few {name}").alias("check"), F.col("n").cast("string").alias("detail"))
        out = few if out is None else out.unionByName(few)
    missing = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("source"), F.lit("")) == "", "source"),
            F.when(F.col("metadata").isNull(), "metadata"),
            F.when(~F.coalesce(F.col("metadata.chunk_type").isin("text", "table"), F.lit(False)), "chunk_type"),
            F.when(F.coalesce(F.col("content"), F.lit("")) == "", "content"),
        )
    )
    out = out.unionByName(chunks.select(F.explode(missing).alias("check"), F.col("chunk_id").alias("detail")))
    return out.unionByName(dangling_ids(cases, "question_id", "expected_context_ids", chunks).select(F.lit("dangling id").alias("check"), F.col("chunk_id").alias("detail")))
