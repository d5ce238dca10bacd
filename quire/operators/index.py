"""Hybrid index of chunks: encoder, stored embeddings, retrieval by BM25 and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.operators import chunking, retrieval
from quire.operators.inverted import InvertedIndex, build_inverted
from quire.sources import io

CACHE = "model string, chunk_id string, digest string, embedding array<float>"
SEARCHED = ("source", "title", "section", "subsection", "content", "text")


def encoder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch_size: int = 64) -> Callable[[Column], Column]:
    """Text to unit vectors. ``load`` runs once in each Python worker and gives the function from texts to vectors."""

    def make():
        model = load()

        def predict(texts):
            v = np.asarray(model([str(x) for x in texts.ravel()]), np.float32)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            return v / np.where(size > 0, size, 1)

        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def search_text() -> Column:
    return tx.search_text(*SEARCHED)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def build_index(chunks: DataFrame, path: str, encode: Callable[[Column], Column], model: str, recreate: bool = False) -> DataFrame:
    """(chunk_id, embedding) of every chunk, from the cache at ``path``; what it lacks is encoded and added first.

    A cached vector is valid for its model, chunk and text, so a changed chunk alone is encoded again. ``chunks`` has one
    row of each id (``last_wins``); ``recreate`` replaces the whole cache.
    """
    spark = chunks.sparkSession
    texts = chunks.withColumn("__search", search_text())
    cache = None if recreate else read_cache(spark, path)
    known = cache if cache is not None else spark.createDataFrame([], CACHE)
    missing = retrieval.embed_missing(texts, known, encode(F.col("__text")), model, text="__search")
    missing.write.mode("overwrite" if recreate else "append").parquet(path)
    want = texts.select(F.lit(model).alias("model"), "chunk_id", F.sha2("__search", 256).alias("digest"))
    # two runs at once may both have added a chunk
    return want.join(spark.read.schema(CACHE).parquet(path), ["model", "chunk_id", "digest"]).select("chunk_id", "embedding").dropDuplicates(["chunk_id"])


@dataclass(frozen=True)
class HybridIndex:
    """Chunks, one of each id, with their vectors, their kept inverted index and the encoder for questions."""

    chunks: DataFrame
    vectors: DataFrame
    terms: InvertedIndex
    encode: Callable[[Column], Column]

    @classmethod
    def build(cls, chunks: DataFrame, path: str, encode: Callable[[Column], Column], model: str, recreate: bool = False) -> HybridIndex:
        """Vectors are kept at ``path``, the inverted index beside it, so that a search reads the texts of its results alone."""
        one = chunking.last_wins(chunks)
        ids = one.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("chunk_id")).alias("told")).first()
        if ids["n"] != ids["told"]:
            raise ValueError("two chunk ids have one 64-bit hash, by which vectors are found: rename one of them")
        terms = build_inverted(one, "chunk_id", tx.tokenize_retrieval(search_text()), f"{path.rstrip('/')}_terms")
        return cls(one, build_index(one, path, encode, model, recreate), terms, encode)

    @classmethod
    def from_jsonl(cls, spark: SparkSession, chunks: str, schema: T.StructType | str, path: str, encode: Callable[[Column], Column], model: str) -> HybridIndex:
        return cls.build(io.read_jsonl(spark, chunks, schema), path, encode, model)

    def retrieve(self, questions: DataFrame, key: str, question: str, top_k: int = 4, candidate_k: int = 20, chunk_types: Sequence[str] | None = None, prune: bool = True) -> DataFrame:
        """(key, position, bm25_rank, vector_rank, rrf_score) and the columns of the chunk, best ``top_k`` of each question.

        Expanded questions meet the inverted index of the search texts and exact cosine; both lists are fused, filtered by type after the fusion,
        and pruned, which drops chunks that repeat others. Equal scores go by the chunk's id, of vectors by its hash.
        Questions are unique by key; a null key is left out.
        """
        asked = questions.where(F.col(key).isNotNull()).select(F.col(key), F.xxhash64(key).alias("q"), tx.expand_query(question).alias("asked"))
        listed = self.terms.search(asked, "q", tx.tokenize_retrieval("asked"), candidate_k)
        vectors = self.vectors.select(F.xxhash64("chunk_id").alias("doc"), "chunk_id", "embedding")
        near = retrieval.semantic_search(asked.select("q", self.encode(F.col("asked")).alias("v")), "q", "v", vectors, "doc", "embedding", candidate_k)
        near = near.join(vectors.select("doc", "chunk_id"), "doc").drop("doc").withColumnRenamed("chunk_id", "doc")
        docs = self.chunks.withColumn("doc", F.col("chunk_id"))
        found = retrieval.hybrid_retrieve(listed, near, docs, "q", top_k, chunk_types)
        got = found.join(asked.select(key, "q"), "q").join(docs, "doc").drop("q", "doc")
        if not prune:
            return got
        body = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.col("content"))
        kept = retrieval.prune_context(got.withColumn("__body", body), key, "position", "__body").withColumnRenamed("text", "__text")
        return got.join(kept, [key, "position"]).withColumns({"text": F.col("__text"), "content": F.col("__text")}).drop("__text")
