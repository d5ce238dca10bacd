"""SimHash near-dedup by multi-index hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Two fingerprints at
distance 4 or less differ in at most 2 bits of one of their 32-bit halves, so they meet in
the middle: both enumerate the Hamming ball of radius 1 round each half (33 keys) and
share a key of that half. Keys held by one fingerprint only are dropped. Of the rest, a
bucket of up to ``BUCKET`` fingerprints is verified at once on complete distances; a
larger one is refined without forming its pairs: its fingerprints also enumerate the ball
of the other half, with the radius that is left to them, and all that meet there are within
distance 4 of each other by the triangle inequality. Both ways find every link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER_TABLE, Scratch
from quire.llm.components import connected_components

BUCKET = 128
LOW32 = 0xFFFFFFFF


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text, as a signed 64-bit integer."""
    w = text.translate(LOWER_TABLE).split()
    n = len(w)
    if not n:
        return 0
    s, x = b" ".join(w), xxhash.xxh64_intdigest
    if n <= shingle:
        h = [x(s, seed)]
    else:
        size = np.fromiter(map(len, w), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        h = [x(s[i:j], seed) for i, j in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    a = np.array(h, np.uint64)
    if len(a) < 64:
        ones = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        by = a.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(by[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = np.packbits(2 * ones > len(a), bitorder="little")
    return int(bits.view(np.int64)[0])


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fp = [simhash(t or b"", shingle) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "id long, fp long")


def _forests(batches, radius: int):
    """Spanning forest of each bucket's links, from the complete distances."""
    for pdf in batches:
        out = []
        for fps in pdf["fps"]:
            a = np.unique(np.asarray(fps, np.int64)).view(np.uint64)
            i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius, 1))
            up = list(range(len(a)))
            for p, q in zip(i.tolist(), j.tolist()):
                r, s = p, q
                while up[r] != r:
                    up[r] = up[up[r]]
                    r = up[r]
                while up[s] != s:
                    up[s] = up[up[s]]
                    s = up[s]
                if r != s:
                    up[max(r, s)] = min(r, s)
                    out.append((int(a[p].view(np.int64)), int(a[q].view(np.int64))))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all of distinct ``fps(fp)`` at distance 4 or less.

    Some implied links are left out; the components are those of all links.
    """
    ball1 = F.array(*[F.lit(x) for x in [0, *(1 << i for i in range(32))]])
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW32))
    keys = F.concat(
        F.transform(ball1, lambda m: F.shiftleft(hi.bitwiseXOR(m), 1)),
        F.transform(ball1, lambda m: F.shiftleft(lo.bitwiseXOR(m), 1).bitwiseOR(F.lit(1))),
    )
    # a small table comes in few partitions, and each row makes 66
    spread = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = fps.repartition(spread, "fp").select("fp", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(shared, "key")
    small = (
        met.where(F.col("n") <= bucket)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
        .mapInPandas(lambda it: _forests(it, 4), "a long, b long")
    )
    own = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, hi).otherwise(lo)
    other = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, lo).otherwise(hi)
    two = [0, *(1 << i for i in range(32)), *((1 << i) | (1 << j) for i, j in combinations(range(32), 2))]
    ball2 = F.array(*[F.lit(x) for x in two])
    left = F.when(F.shiftrightunsigned("key", 1) == own, F.lit(len(two))).otherwise(F.lit(33))
    mid = met.where(F.col("n") > bucket).select(
        "key", "fp", F.explode(F.transform(F.slice(ball2, F.lit(1), left), lambda m: other.bitwiseXOR(m))).alias("y")
    )
    hub = mid.groupBy("key", "y").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    large = mid.join(hub, ["key", "y"]).where("fp != b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(large.distinct()).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bucket: int = BUCKET
) -> DataFrame:
    """One row per input row: (id_col, fp, component_id).

    component_id is the smallest id reachable by links of distance 4 or less, the row's own
    included. Equal fingerprints are one node, so copies are never expanded. Null and empty
    texts share fingerprint 0 and link like any other; a null id is no candidate for
    component_id, which is null only if every id of its group is; repeated rows are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    fp = scratch.table(fingerprints(docs, id_col, text_col, shingle))
    nodes = scratch.table(fp.groupBy("fp").agg(F.min("id").alias("first_id")))
    links = fingerprint_links(nodes.select("fp"), bucket)
    comp = connected_components(links, scratch)
    rooted = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = scratch.table(rooted.join(least, "root").select("fp", "component_id"))
    scratch.drop(nodes)
    return fp.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
