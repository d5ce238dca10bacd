"""A kept inverted index, dealt by documents.

Documents are dealt to blocks, as many of them to each bucket. ``postings`` is a bucketed Parquet table, sorted by block and term, with a row for
each block and term that holds the term's postings in the block. ``terms`` has the document frequencies, ``totals`` the figures of the corpus. A
search reads no text. All rows of a document are in one bucket, so its score is summed where it is read, in arrays of queries by the
documents of a block, and only each bucket's best are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import scores
from quire.operators.retrieval import BROADCAST_TERMS, EPSILON, K1, B

#: Documents of a bucket, which one task builds and reads block by block.
BUCKET_DOCS = 1 << 14
#: Buckets of a small index.
LEAST_BUCKETS = 16
#: Terms of all queries up to which the scan gets them as a filter on the sorted files.
PUSHED_TERMS = 500
#: ``postings`` are ``n`` pairs of whole numbers of ``PAIR``: a place in the block's ``keys`` and the term's count there. ``keys`` stand in order in the row of the null term alone,
#: whose counts are the documents' lengths.
ROWS = "bucket INT, block INT, term STRING, n BIGINT, words BIGINT, keys ARRAY<{key}>, postings BINARY"
PAIR = np.dtype("<i4")


def impact(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """A posting's share of the score, without its term's weight: it grows with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / max(avgdl, 1e-9)))


def _raw(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def build_inverted(corpus: DataFrame, key: str, tokens: Column, path: str, block_docs: int = 2048) -> InvertedIndex:
    """Write the index of ``corpus`` to ``path`` in place of one that is there; texts are read once, their tokens are dealt to the buckets once.

    Documents go to blocks of about ``block_docs`` by a hash of their key, so no term, however frequent, gathers more than a
    block in one row or a bucket in one task. Keys are unique; documents with a null key are left out. Every document has one
    posting of the null term, with its length, so those without a token count too.
    """
    spark = corpus.sparkSession
    docs = corpus.where(F.col(key).isNotNull())
    n = docs.count()
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_DOCS))
    each = max(1, -(-n // (buckets * block_docs)))
    block = F.pmod(F.xxhash64(key), F.lit(buckets * each)).cast("int")
    dealt = docs.select(F.col(key).alias("doc"), block.alias("block"), tokens.alias("t"))
    dealt = dealt.select(F.get(F.lit(_numbers(spark, buckets)), F.floor(F.col("block") / each).cast("int")).alias("bucket"), "block", "doc", "t")
    rows = dealt.repartition(buckets, "bucket").groupBy("bucket", "block").applyInArrow(_posted, ROWS.format(key=docs.schema[key].dataType.simpleString()))
    name = _name()
    rows.write.mode("overwrite").bucketBy(buckets, "bucket").sortBy("block", "term").option("path", f"{path}/postings").saveAsTable(name)
    held = spark.read.table(name)
    terms = held.groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words")).repartition(LEAST_BUCKETS, "term").sortWithinPartitions("term")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.sql(f"DROP TABLE {name}")
    terms = spark.read.parquet(f"{path}/terms")
    count = terms.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    mean = terms.where("term IS NOT NULL").join(F.broadcast(count.select("n")), F.lit(True)).agg(F.coalesce(F.avg(_raw(F.col("df"), F.col("n"))), F.lit(0.0)).alias("mean_raw"))
    avgdl = F.when(F.col("n") > 0, F.col("words") / F.col("n")).otherwise(0.0).alias("avgdl")
    key_type = F.lit(docs.schema[key].dataType.simpleString()).alias("key_type")
    count.join(mean, F.lit(True)).select("n", avgdl, "mean_raw", F.lit(buckets).alias("buckets"), key_type).write.mode("overwrite").parquet(f"{path}/totals")
    return InvertedIndex(spark, path)


def _numbers(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket that Spark's hash puts into it, so that every bucket has one."""
    ids = spark.range(64 * buckets).select(F.col("id").cast("int").alias("id"))
    first = {r["b"]: r["id"] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("b")).agg(F.min("id").alias("id")).collect()}
    return [first.get(b, b) for b in range(buckets)]


def _posted(rows: pa.Table) -> pa.Table:
    """The postings of one block, from its documents' tokens in (bucket, block, doc, t)."""
    number, keys = scores.ordered(rows.column("doc").combine_chunks())
    size = pc.fill_null(pc.list_value_length(rows.column("t")), 0).to_numpy()
    dl = np.zeros(len(keys), np.int64)
    dl[number[::-1]] = size[::-1]
    of = rows.schema.field("t").type.value_type
    words = pa.chunked_array([c.flatten() for c in rows.column("t").chunks], of).dictionary_encode().unify_dictionaries()
    codes = np.concatenate([np.zeros(0, np.int64), *(c.indices.to_numpy(zero_copy_only=False) for c in words.chunks)])
    terms = words.chunk(0).dictionary if words.num_chunks else pa.array([], of)
    pair, tf = np.unique(codes * len(keys) + np.repeat(number, size), return_counts=True)
    term, at = np.divmod(pair, len(keys))
    n = np.bincount(term, minlength=len(terms))
    edge = len(keys) + np.concatenate([[0], np.cumsum(n)])
    tf = np.concatenate([dl, tf])
    words = np.add.reduceat(tf, np.concatenate([[0], edge[:-1]])) if len(terms) else [dl.sum()]
    pairs = np.stack([np.concatenate([np.arange(len(keys)), at]), tf], 1).astype(PAIR)
    postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(np.concatenate([[0], edge]) * (2 * PAIR.itemsize)), pa.py_buffer(pairs)])
    m = len(edge)
    return pa.table({
        "bucket": pa.repeat(rows.column("bucket")[0], m), "block": pa.repeat(rows.column("block")[0], m), "term": pa.concat_arrays([pa.nulls(1, of), terms]),
        "n": pa.array(np.concatenate([[len(keys)], n]), pa.int64()), "words": pa.array(words, pa.int64()),
        "keys": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.nulls(m - 1, pa.list_(keys.type))]), "postings": postings.cast(pa.binary()),
    })


def _name() -> str:
    return f"quire_postings_{uuid.uuid4().hex}"


@dataclass(frozen=True)
class InvertedIndex:
    """The index at ``path``, as ``build_inverted`` wrote it."""

    spark: SparkSession
    path: str

    def totals(self) -> dict[str, object]:
        """n, avgdl, mean_raw (the mean raw inverse document frequency), buckets and key_type."""
        return self.spark.read.parquet(f"{self.path}/totals").first().asDict()

    def terms(self, totals: dict[str, object] | None = None) -> DataFrame:
        """(term, df, idf) of every term; what is negative becomes a share of the mean."""
        t = totals or self.totals()
        raw = _raw(F.col("df"), F.lit(t["n"]))
        idf = F.when(raw < 0, F.lit(EPSILON * t["mean_raw"])).otherwise(raw)
        return self.spark.read.parquet(f"{self.path}/terms").where("term IS NOT NULL").select("term", "df", idf.alias("idf"))

    def postings(self, totals: dict[str, object]) -> DataFrame:
        """The postings, with their bucketing known to the planner."""
        name = _name()
        self.spark.sql(
            f"CREATE TABLE {name} ({ROWS.format(key=totals['key_type'])}) USING parquet CLUSTERED BY (bucket) SORTED BY (block, term) INTO {totals['buckets']} BUCKETS LOCATION '{self.path}/postings'"
        )
        held = self.spark.read.table(name)
        # the analysed plan keeps files and buckets; the name was only needed to state them
        self.spark.sql(f"DROP TABLE {name}")
        return held

    def search(self, queries: DataFrame, query_key: str, query_tokens: Column, top_k: int = 5) -> DataFrame:
        """(query_key, doc, bm25_score, bm25_rank): best ``top_k`` documents, ties by key, then scores above 0 only.

        Every posting of a query's terms is scored, where it lies; queries travel in blocks, each of which reads the index once.
        """
        t = self.totals()
        avgdl, kind = float(t["avgdl"]), queries.select(F.col(query_key)).schema[0].dataType.simpleString()
        q = queries.select(F.col(query_key).alias("q"), F.explode(query_tokens).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))
        blocks = scores.query_blocks(self.terms(t).join(q, "term").select("q", "term", (F.col("qtf") * F.col("idf")).alias("w")))
        held = self.postings(t).drop("n", "words")
        parts = [self._scored(held, b, avgdl, top_k, f"q {kind}, doc {t['key_type']}, s double") for b in blocks]
        every = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"q {kind}, doc {t['key_type']}, s double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bm25_score"), "doc"))
        best = every.select("q", "doc", F.round("s", 9).alias("bm25_score")).withColumn("bm25_rank", rank).where((F.col("bm25_rank") <= top_k) & (F.col("bm25_score") > 0))
        return best.select(F.col("q").alias(query_key), "doc", "bm25_score", "bm25_rank")

    def _scored(self, held: DataFrame, block: Broadcast, avgdl: float, top_k: int, schema: str) -> DataFrame:
        """(q, doc, s): the best of each bucket of documents for each query of one block. The scan is bucketed, so nothing is shuffled."""
        asked = block.value.terms
        if len(asked) <= PUSHED_TERMS:
            held = held.where(F.col("term").isin(asked.to_pylist()) | F.col("term").isNull())
        elif len(asked) <= BROADCAST_TERMS:
            want = self.spark.createDataFrame(pa.table({"want": pa.concat_arrays([asked, pa.nulls(1, asked.type)])}))
            held = held.join(F.broadcast(want), F.col("term").eqNullSafe(F.col("want")), "left_semi")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = scores.Best(block.value, top_k)
            for rows in _blocks(batches):
                keys, term, at, value = _values(rows, block.value, avgdl)
                got.take(keys, term, at, value)
            yield from got.found().to_batches()

        # a bucket's rows come block by block
        return held.sortWithinPartitions("bucket", "block").groupBy("bucket").applyInArrow(score, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches in the order of blocks."""
    parts: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column("block").to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for lo, hi in zip(edge, edge[1:]):
            if parts and hi > lo and parts[0].column("block")[0].as_py() != block[lo]:
                yield pa.Table.from_batches(parts)
                parts = []
            if hi > lo:
                parts.append(b.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _values(rows: pa.Table, queries: scores.Queries, avgdl: float) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, term, place, impact) of a block: its keys and its postings of the queries' terms."""
    whole = rows.filter(pc.is_null(rows.column("term")))
    keys, dl = whole.column("keys").combine_chunks().flatten(), _pairs(whole)[:, 1]
    number = queries.find(rows.column("term").combine_chunks())
    rows = rows.filter(pa.array(number >= 0))
    at, tf = _pairs(rows).T
    term = np.repeat(number[number >= 0], pc.binary_length(rows.column("postings")).to_numpy() // (2 * PAIR.itemsize))
    return keys, term, at.astype(np.int64), impact(tf.astype(np.float64), dl[at], avgdl)


def _pairs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("postings").to_pylist()), PAIR).reshape(-1, 2)
