"""Sharding by sampled splitters.

Records are ordered by (hash of text, id, a number of their own), so copies of a text lie together and
any group can be divided. A size-weighted sample of these keys gives quantile boundaries of many small ranges;
overfull ranges are subdivided from denser samples of their own until none is left; exact byte counts of the
ranges then place the cuts between shards, and a row number within each range, plus the
rows of the ranges before it, is a record's slot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch

#: Ranges, rows of each as long as there may be more ranges, and sampled keys for each. The driver holds the
#: sample: MAX_RANGES * KEYS_PER_RANGE keys, 32 MB; beyond MAX_RANGES * ROWS_PER_RANGE rows ranges grow.
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE, KEYS_PER_RANGE = 512, 65_536, 20_000, 16
#: A group of equal texts up to this share of a shard is not cut in two.
WHOLE_GROUP = 0.005
_LOWEST = -(1 << 63)
_KEY = ("k", "d", "o")
_KIND = np.dtype([(c, np.int64) for c in _KEY])


def _records(keys) -> np.ndarray:
    out = np.zeros(len(keys[0]), _KIND)
    for c, v in zip(_KEY, keys):
        out[c] = v
    return out


def _place(k: np.ndarray, d: np.ndarray, o: np.ndarray, bounds: list[tuple[int, int, int]]) -> np.ndarray:
    """Number of boundaries at or before each key (k, d, o)."""
    b = np.array(bounds, _KIND)
    lo, hi = np.searchsorted(b["k"], k, "left"), np.searchsorted(b["k"], k, "right")
    tied = np.flatnonzero(hi > lo)
    if len(tied):
        lo[tied] = np.searchsorted(b, _records((k[tied], d[tied], o[tied])), "right")
    return lo.astype(np.int32)


def _ranged(slim: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """Adds the range of each row; only the key columns go through Python."""
    if not bounds:
        return slim.withColumn("range", F.lit(0))

    @F.pandas_udf("int")
    def at(k: pd.Series, d: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series(_place(k.to_numpy(), d.to_numpy(), o.to_numpy(), bounds))

    return slim.withColumn("range", at(*_KEY))


def _quantiles(sample: pd.DataFrame, parts: int) -> list[tuple[int, int, int]]:
    if not len(sample):
        return []
    keys = _records([sample[c].to_numpy() for c in _KEY])
    order = np.argsort(keys)
    acc = np.cumsum(sample["w"].to_numpy()[order])
    at = np.minimum(np.searchsorted(acc, acc[-1] * np.arange(1, parts) / parts), len(keys) - 1)
    return sorted({keys[order[i]].item() for i in at.tolist()})


def _planned(docs: DataFrame, n_shards: int, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, and the row itself as the struct ``whole`` if it is kept."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    t = F.col(text_col)
    held = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"),
        F.xxhash64(t).alias("k"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("d"),
        F.monotonically_increasing_id().alias("o"),
        *([F.struct(*docs.columns).alias("whole")] if keep else []),
    )
    held = scratch.table(held)
    slim = held.drop("whole")
    out = ["doc_id", "size", "text_crc32", "shard", "slot", *(["whole"] if keep else [])]
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return held.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*out)
    parts = min(MAX_RANGES, max(MIN_RANGES, math.ceil(rows / ROWS_PER_RANGE)))
    weight = F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)
    chance = F.pmod(F.xxhash64(*_KEY, F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def draw(df: DataFrame, n: float) -> pd.DataFrame:
        w = weight * F.lit(n / 2)
        return df.select(*_KEY, F.greatest(w, F.lit(1.0)).alias("w"), (chance < w).alias("drawn")).where("drawn").drop("drawn").toPandas()

    bounds = _quantiles(draw(slim, parts * KEYS_PER_RANGE), parts)

    def measure():
        got = _ranged(slim, bounds).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
        return {r["range"]: (r["n"], r["b"]) for r in got}

    hist, denser = measure(), 4
    while True:
        over = {r: math.ceil(max(n * parts / rows, b * parts / total)) for r, (n, b) in hist.items() if n > 4 and max(n * parts / rows, b * parts / total) > 3}
        if not over or denser > 1 << 20:
            break
        full = F.array_contains(F.array(*[F.lit(r) for r in over]), F.col("range")) if len(over) <= 1000 else F.col("range") >= 0
        more = draw(_ranged(slim, bounds).where(full), parts * KEYS_PER_RANGE * denser)
        home = _place(*(more[c].to_numpy() for c in _KEY), bounds) if bounds else np.zeros(len(more), np.int32)
        new = set(bounds)
        for r, part in more.groupby(home):
            if r in over:
                new |= set(_quantiles(part, over[r]))
        denser *= 4
        if len(new) > len(bounds):
            bounds = sorted(new)
            hist = measure()

    cuts = _cuts(slim, bounds, hist, total, n_shards)
    bounds = sorted({*bounds, *cuts})
    hist = measure()
    starts = [(_LOWEST,) * 3, *bounds]
    place, before = [], [0] * n_shards
    for r in sorted(hist):
        s = sum(c <= starts[r] for c in cuts)
        place.append((r, s, before[s]))
        before[s] += hist[r][0]
    offsets = F.broadcast(spark.createDataFrame(place, "range int, shard int, first long"))
    w = Window.partitionBy("range").orderBy(*_KEY)
    ranked = _ranged(held, bounds).withColumn("slot", F.row_number().over(w).cast("long") - 1).join(offsets, "range")
    return ranked.withColumn("slot", F.col("slot") + F.col("first")).select(*out)


def _cuts(slim: DataFrame, bounds, hist, total: int, n_shards: int) -> list[tuple[int, int, int]]:
    """Keys at which shards 1, 2, ... start: the record nearest to each equal part of the bytes."""
    acc, holds = 0, {}
    for r in sorted(hist):
        for i in range(1, n_shards):
            if acc < total * i / n_shards <= acc + hist[r][1]:
                holds.setdefault(r, []).append((i, acc))
        acc += hist[r][1]
    if not holds:
        return []
    run = F.sum("size").over(Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0))
    near = _ranged(slim, bounds).where(F.col("range").isin(list(holds))).withColumn("run", run)
    hit = F.lit(False)
    for r, targets in holds.items():
        for i, start in targets:
            goal = total * i / n_shards - start
            hit = hit | ((F.col("range") == r) & (F.col("run") >= goal) & (F.col("run") - F.col("size") < goal))
    base = {r: targets[0][1] for r, targets in holds.items()}
    found = near.where(hit).select("range", *_KEY, "size", "run").collect()
    of = slim.where(F.col("k").isin([r.k for r in found]))
    sizes = {r.k: r.g for r in of.groupBy("k").agg(F.sum("size").alias("g")).collect()}
    cuts = set()
    for r in found:
        end = base[r["range"]] + r.run
        begin = end - r.size
        goal = min((total * i / n_shards for i in range(1, n_shards)), key=lambda x: abs(x - end))
        if sizes[r.k] <= WHOLE_GROUP * total / n_shards:
            earlier = (F.col("d") < r.d) | ((F.col("d") == r.d) & (F.col("o") < r.o))
            ahead = of.where((F.col("k") == r.k) & earlier).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            left = begin - ahead
            after = left + sizes[r.k] - goal < goal - left
            cuts.add((r.k + 1 if after else r.k, _LOWEST, _LOWEST))
        else:
            cuts.add((r.k, r.d, r.o if goal - begin <= end - goal else r.o + 1))
    return sorted(cuts)


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard (from 0), slot (gapless from 0).

    Shards are near equal in bytes (size: UTF-8 bytes plus 1; a null text has none). Equal texts share a
    shard unless their group is larger than ``WHOLE_GROUP`` of one. Null texts form one group;
    a null id sorts first; repeated rows get slots of their own; other columns are ignored;
    an empty table gives no rows. One record larger than a shard makes that shard larger.
    """
    return _planned(docs, n_shards, id_col, text_col, keep=False)


def shard_rows(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` as they are, with size, text_crc32, shard and slot as in ``shard_documents``; columns of these four names are replaced."""
    added = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in docs.columns if c.lower() not in added]
    return _planned(docs, n_shards, id_col, text_col, keep=True).select(*(F.col("whole")[c].alias(c) for c in kept), *added)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``shard_rows`` under ``path/shard=N``, each file in order of slots, and return what was written."""
    rows = shard_rows(docs, n_shards, id_col, text_col)
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
