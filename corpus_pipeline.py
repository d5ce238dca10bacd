"""Corpus pipeline: language ID, SimHash near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents`` as they
were; the last adds each kept document's size, text_crc32, shard and slot. Every stage works on
all that the one before kept. Rows are judged by themselves, not by their ids: a null id or one that different
texts share changes nothing, and of equal rows near-dedup keeps one. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, fresh
from quire.llm.decontam import drop_contaminated
from quire.llm.langid import fit_languages, identify_language
from quire.llm.queries import held_out, mixture
from quire.llm.sharding import shard_rows
from quire.llm.simhash_similar import drop_similar

#: A text of which the filters know fewer than this share of n-grams is in none of the languages.
MIN_COVERAGE = 0.25
SHARDS = 8

# SQL can express neither the fitted filters nor the alignment.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; those without letters or unknown to all filters go."""
    model = fit_languages(docs.where(~held_out(docs)))
    pred, score, coverage = fresh(docs.columns, "lang_pred", "score", "coverage")
    told = identify_language(docs, model, names=(pred, score, coverage))
    return told.where((F.col(pred) != "und") & (F.col(coverage) >= MIN_COVERAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_similar(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copied or edited benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the raked weights of source, language and text form."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return mixture(docs, prefix=prefix).where(f"`{prefix}sampled`").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, text_crc32, shard and slot."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
