"""Stage runner: download, extract, chunk, evaluate, each a function in one session."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunking, generation, reporting, scoring
from quire.operators.index import HybridIndex
from quire.sources import io


def run_stages(stages: Sequence[tuple[str, Callable[[], object]]]) -> list[str]:
    """Run named stages in order; the first failure stops the run and is raised with its stage's name."""
    done = []
    for name, stage in stages:
        try:
            stage()
        except Exception as e:
            raise RuntimeError(f"stage {name} failed after {done}") from e
        done.append(name)
    return done


def build_chunk_table(elements: DataFrame, path: str, max_words: int = 220, overlap: int = 40) -> DataFrame:
    chunking.build_chunks(elements, max_words, overlap).write.mode("overwrite").parquet(path)
    return elements.sparkSession.read.parquet(path)


def run_eval(spark: SparkSession, cases: DataFrame, chunks: DataFrame, out: str | None = None, key: str = "question_id", ids: str = "retrieved_context_ids", thresholds=None, index: HybridIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, one-row summary) of cases with question, answer, expected_route and context ids; written under ``out`` if given."""
    return run_experiment(spark, scoring.resolve_contexts(cases, key, ids, chunking.last_wins(chunks)), out, key, thresholds, index=index)[:2]


def run_experiment(spark: SparkSession, answered: DataFrame, out: str | None = None, key: str = "question_id", thresholds=None, strict: bool = False, index: HybridIndex | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(results, one-row summary, passed) of ``answered(key, question, answer, expected_route, contexts)``.

    ``out`` gets results, summary and, where contexts carry their ranks, a debug trace with previews of them. ``passed`` is
    always true unless ``strict``, which asks that every case has its expected route. With ``index`` answers are encoded by its
    encoder and compared with its vectors of their contexts; without one semantic scores are 0. Keys are unique.
    """
    if out:
        # answers may come from a chat service: they are asked for once
        answered.write.mode("overwrite").parquet(f"{out}/answers")
        answered = spark.read.parquet(f"{out}/answers")
    semantic = None
    if index is not None:
        name = "__semantic"
        answered = answered.join(scoring.semantic_scores(answered, key, index.encode, index.vectors).withColumnRenamed("semantic_score", name), key)
        semantic = F.col(name)
    scored = scoring.with_pass(scoring.evaluate(answered, semantic, thresholds=thresholds or io.load_thresholds())).drop("__semantic")
    results = scored.drop("contexts")
    if out:
        results.write.mode("overwrite").parquet(f"{out}/results")
        results = spark.read.parquet(f"{out}/results")
        if "rrf_score" in scored.schema["contexts"].dataType.elementType.names:
            trace = answered.select(key, reporting.context_preview(F.col("contexts")).alias("contexts"))
            io.write_jsonl(results.join(trace, key, "left"), f"{out}/debug")
    summary = reporting.quality_summary(results, key, key)
    if out:
        io.write_jsonl(summary, f"{out}/summary", single=True)
    return results, summary, not strict or results.where(~F.coalesce("pass", F.lit(False))).isEmpty()


def live_answers(cases: DataFrame, index: HybridIndex, transport: Callable[[list[dict]], str], key: str = "question_id", top_k: int = 4) -> DataFrame:
    """``cases(key, question, expected_route)`` with answer, contexts and retrieved_context_ids: retrieve, ask, parse.

    A case for which nothing is found is asked with an empty context. Each case is one request, made again if its task is.
    """
    found = index.retrieve(cases, key, "question", top_k)
    fields = [c for c in found.columns if c not in (key, "position")]
    crumb = generation.breadcrumb(F.col("hierarchy_path"), F.col("title"), F.col("section"), F.col("subsection"))
    block = generation.context_block(crumb, F.col("chunk_type"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("c"), block.alias("b"))))
    per = found.groupBy(key).agg(rows.alias("s")).select(
        key,
        F.transform("s", lambda x: x["c"]).alias("contexts"),
        F.transform("s", lambda x: x["c"]["chunk_id"]).alias("retrieved_context_ids"),
        F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("context"),
    )
    empty = {c: F.coalesce(c, F.array().cast(per.schema[c].dataType)) for c in ("contexts", "retrieved_context_ids")}
    asked = cases.where(F.col(key).isNotNull()).join(per, key, "left").withColumns(empty)
    said = generation.generate_answers(asked.select(key, generation.messages("question", "context").alias("chat")), key, "chat", transport)
    return asked.drop("context").join(said.select(key, F.col("final_answer").alias("answer")), key)


def extract_stage(spark: SparkSession, catalog: str, raw: str, out: str) -> DataFrame:
    """Elements of the catalogue's files under folder ``raw``, written as JSON lines; a local_path is relative to ``raw``."""
    files = io.read_files(spark, raw).withColumn("local_path", F.substring_index("path", raw.rstrip("/") + "/", -1)).drop("path")
    elements = io.extract_documents(io.read_catalog(spark, catalog), files)
    io.write_jsonl(elements, out)
    return io.read_jsonl(spark, out, elements.schema)


def chunk_stage(spark: SparkSession, extracted: str, starter: str, schema, out: str, source: str = "auto") -> DataFrame:
    """Chunks of the extracted documents, of the starter ones, or (auto) of the former if there are any."""
    docs = io.pick_source(spark, extracted, starter, schema) if source == "auto" else io.read_jsonl(spark, extracted if source == "extracted" else starter, schema)
    if docs.isEmpty():
        raise FileNotFoundError(f"no documents to chunk: {source}")
    return build_chunk_table(docs, out)


def quick_run(cases: DataFrame, chunks: DataFrame, catalog: DataFrame, out: str, before: Sequence[tuple[str, Callable[[], object]]] = (), key: str = "question_id") -> list[str]:
    """Stages ``before`` (such as download, extract, chunk), then scores the starter answers and verifies the package; the first failure stops."""

    def verify():
        problems = reporting.package_problems(catalog, chunks, cases)
        if not problems.isEmpty():
            raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in problems.limit(20).collect()))

    spark = cases.sparkSession
    return run_stages([*before, ("evaluate", lambda: run_eval(spark, starter_answers(cases), chunks, out, key)), ("verify", verify)])


def starter_answers(cases: DataFrame) -> DataFrame:
    """Evaluation rows as outputs: the reference answer, with the expected contexts as retrieved."""
    return cases.selectExpr("question_id", "question", "reference_answer AS answer", "expected_context_ids AS retrieved_context_ids", "expected_route")
