"""Incremental feed of the knowledge base: new and changed documents become chunks.

    python -m jobs.knowledge_feed --documents IN --out OUT --checkpoint CP [--config jobs/knowledge_feed.json]

A file stream takes the files that came since the last run, in batches of at most ``files_per_batch`` files, and ends when
there are none left. Each batch writes three Parquet tables under OUT, partitioned by its number:

* ``ledger``: (doc_id, digest) of the documents that were new or changed,
* ``chunks``: their chunks, partitioned by language too,
* ``rejected``: rows that no chunk can be traced back to, with the reason.

A document delivered again unchanged adds nothing; a changed one replaces its chunks, which ``current_chunks`` sees
to: of each document only the chunks of its latest batch count. A batch that is run again after a failure overwrites its own partitions
with the same rows, so the tables hold each document's chunks once.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, open_table, overwrite_partitions, part_of, read_config, read_table, session, settings
from quire.operators import chunking

DEFAULTS = {"max_words": 220, "overlap": 40, "files_per_batch": 256}
LEDGER = "doc_id long, digest string, batch long"
CHUNKS = (
    "chunk_id string, doc_id long, section_no int, part_no int, source string, lang string, section string, hierarchy_path array<string>, "
    "text string, token_count_approx int, batch long, lang_part string"
)
REJECTED = "doc_id long, text string, lang string, source string, reason string, batch long"


def latest(ledger: DataFrame) -> DataFrame:
    """(doc_id, digest, batch) of each document's last delivery."""
    return ledger.groupBy("doc_id").agg(F.max(F.struct("batch", "digest")).alias("m")).select("doc_id", "m.digest", "m.batch")


def digest() -> Column:
    return F.sha2(F.to_json(F.struct("text", "lang", "source")), 256).alias("digest")


def fresh_ids(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest) of the documents that the ledger ``known`` hasn't got as they are.

    Of different rows of one id the one with the greatest digest counts, whatever their order.
    """
    one = docs.select("doc_id", digest()).groupBy("doc_id").agg(F.max("digest").alias("digest"))
    return one.join(latest(known).select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")


def chunk_rows(docs: DataFrame, max_words: int, overlap: int) -> DataFrame:
    """The chunks of documents, in the columns of ``CHUNKS`` but for the partition columns."""
    elements = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text", F.col("doc_id").alias("doc_ord"), "lang")
    return chunking.build_chunks(elements, max_words, overlap, keep=["lang"]).select(
        "chunk_id", F.col("doc_ord").alias("doc_id"), "section_no", "part_no", "source", "lang", "section", "hierarchy_path", "text", "token_count_approx"
    )


def take_batch(batch: DataFrame, number: int, out: str, config: Mapping[str, object]) -> dict[str, int]:
    """Write one batch's ledger, chunks and rejected rows; the counts of what was read and written."""
    spark = batch.sparkSession
    read, kept, made = Observation(), Observation(), Observation()
    rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    docs = rows.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("rejected"))
    known = read_table(spark, f"{out}/ledger", LEDGER)
    fresh = fresh_ids(docs.where("doc_id IS NOT NULL"), known.where(F.col("batch") < number))
    number_col = F.lit(number).cast("long").alias("batch")
    ledger = fresh.select("doc_id", "digest", number_col).observe(kept, F.count(F.lit(1)).alias("documents"))
    overwrite_partitions(ledger, f"{out}/ledger", "batch")
    # texts are read once more and meet the ledger's rows, rather than being shuffled to find the new ones
    mine = read_table(spark, f"{out}/ledger", LEDGER).where(F.col("batch") == number).select("doc_id", "digest")
    again = rows.withColumn("digest", digest()).join(mine, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    chunks = chunk_rows(again, int(config["max_words"]), int(config["overlap"]))
    chunks = chunks.observe(made, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count_approx"), F.lit(0)).alias("tokens"))
    overwrite_partitions(chunks.select("*", number_col, part_of("lang").alias("lang_part")), f"{out}/chunks", "batch", "lang_part")
    counts = {**read.get, **kept.get, **made.get}
    if counts["rejected"]:
        overwrite_partitions(rows.where("doc_id IS NULL").select("*", F.lit("doc_id is null").alias("reason"), number_col), f"{out}/rejected", "batch")
    log.info("batch %d: read %d rows, %d of them rejected; wrote %d new or changed documents, %d chunks, %d tokens", number, *(counts[k] for k in ("rows", "rejected", "documents", "chunks", "tokens")))
    return counts


def feed(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Mapping[str, object] | None = None) -> dict[str, int]:
    """Take what is new at ``documents``, a folder or a pattern of files, since the last run with ``checkpoint``; the summed counts of its batches."""
    config = settings(DEFAULTS, config or {})
    total = {"batches": 0, "rows": 0, "rejected": 0, "documents": 0, "chunks": 0, "tokens": 0}

    def write(batch: DataFrame, number: int) -> None:
        for name, n in {"batches": 1, **take_batch(batch, number, out, config)}.items():
            total[name] += n

    open_table(spark, f"{out}/ledger", LEDGER, "batch")
    open_table(spark, f"{out}/chunks", CHUNKS, "batch", "lang_part")
    open_table(spark, f"{out}/rejected", REJECTED, "batch")
    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(documents)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    log.info("%s: %s", documents, ", ".join(f"{n} {k}" for k, n in total.items()))
    return total


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The knowledge base as it stands: each document's chunks of its latest batch."""
    chunks, ledger = read_table(spark, f"{out}/chunks", CHUNKS), read_table(spark, f"{out}/ledger", LEDGER)
    return chunks.join(latest(ledger).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch", "lang_part")


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args(argv)
    spark = session("knowledge feed")
    try:
        feed(spark, given.documents, given.out, given.checkpoint, read_config(spark, given.config) if given.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
