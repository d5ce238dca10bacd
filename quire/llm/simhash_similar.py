"""SimHash near-dedup at a similarity of word shingles, by multi-index hashing.

Random bits of the sets of five-word shingles of two texts differ in a share
acos(cosine) / pi of places, so a Jaccard similarity of 0.8 (a cosine of 0.889 for sets of
one size) is 15 % of the bits: too many for the 64-bit fingerprints of ``simhash``. Here a
fingerprint has ``SIZE`` bits, the first of them in ``SEGMENTS`` segments of ``BITS`` bits. Within each segment every text
enumerates a Hamming ball of radius 1 over the ``NEAR`` bits nearest to their majority, the ones
an edit turns first. Texts that share a key of any segment are compared: a complete distance far beyond
the one expected rules a pair out, and the exact Jaccard similarity of the two sets decides.

Majorities of few shingles say little, so sets below ``SHORT`` have no such keys and no distance test. Every text has
keys of ``BANDS`` MinHash bands, which meet at a similarity of 0.8 but for one pair in ten million, at any size.

Buckets never form their pairs. A text is first compared with one other, the least member of most of its bands'
buckets, then with the least members of its bands' buckets and of its buckets of two that are still in another component; a
group of near copies has too many other buckets, each with a least member of its own, to meet those one by one. Only buckets of three or more that still hold more than
one component are gone through again: all members outside the component of a bucket's least member are compared,
block by block, with all members of it, so no link of a shared bucket is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, Scratch, fresh, grams, mix, slices, string_buffers, trim, words
from quire.llm.components import connected_components

SEGMENTS, BITS, NEAR = 34, 30, 6
KEYED = SEGMENTS * BITS
WORDS64 = 32
SIZE = 64 * WORDS64
#: Sets of fewer shingles are not keyed or ruled out by their fingerprints.
SHORT = 128
BANDS, ROWS = 32, 4
#: Share of the bits by which a distance may exceed the one expected at the threshold: over five deviations.
SLACK = 0.05
#: Shares are compared with this tolerance, for products like 0.8 * 15 in floating point.
EXACT = 1e-9
MINOR, MAJOR = 128, 512
#: Texts in the buckets of a component up to which its buckets are gone through together.
WHOLE = 8192
#: Rows that Python takes at a time.
BATCH_ROWS = 1000
#: Bits of a bitmap of keys, 8 MB at any size. With more keys than it can tell apart more rows pass; none is lost.
SLOTS = 1 << 26

_SALTS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1) for i in range(WORDS64)], np.uint64)
_BAND_XOR, _BAND_ODD = np.random.default_rng(20260102).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_BAND_ODD = _BAND_ODD * np.uint64(2) + np.uint64(1)


def shingle_sets(h: np.ndarray, doc: np.ndarray, n: int, shingle: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each of n documents whose word hashes lie one after another."""
    at = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        out.append(np.unique(grams(h[lo:hi], min(shingle, hi - lo))) if hi > lo else np.zeros(0, np.uint64))
    return out


def majorities(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit, distance of its count from the majority) of each place; distances of the keyed places only."""
    ones = np.zeros(SIZE, np.int64)
    for lo in range(0, len(h), 255):
        x = mix(h[lo : lo + 255, None] ^ _SALTS[None, :])
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    twice = 2 * ones - len(h)
    return twice > 0, np.abs(twice[:KEYED] - (len(h) % 2 == 0))


def band_codes(h: np.ndarray) -> np.ndarray:
    """32-bit code of each MinHash band of a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), 1024):
        low = np.minimum(low, ((h[lo : lo + 1024, None] ^ _BAND_XOR) * _BAND_ODD).min(0))
    return (grams(mix(low), ROWS)[::ROWS] >> np.uint64(32)).astype(np.uint32)


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Fingerprints, near places of each segment, and band codes of some shingle sets."""
    bits, far = (np.stack(x) for x in zip(*map(majorities, sets)))
    order = far.reshape(-1, SEGMENTS, BITS).astype(np.int32) * BITS + np.arange(BITS, dtype=np.int32)
    near = np.argpartition(order, NEAR - 1, axis=2)[:, :, :NEAR].astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64), near, [band_codes(x) for x in sets]


def row_keys(id_col: str, text_col: str) -> list:
    """128 bits that name a row by its id and text; a null text counts as empty."""
    i, t = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.lit(1), i, t), F.xxhash64(t, F.lit(2), i)]


def shingle_rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of the documents named by ``ids(id, k1, k2)``.

    A bitmap of the wanted keys tells most other documents apart where they are read, so their texts are neither cut nor shuffled.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.col("k1").bitwiseAND(F.lit(SLOTS - 1)).alias("s"))))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(_set(wanted.value, b.column(0).to_numpy() & (SLOTS - 1))))
            raw, offsets = string_buffers(b.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                doc, _, _, h = words(raw[part[0] : part[-1]], part - part[0], fold=LOWER)
                sets = [x.view(np.int64) for x in shingle_sets(h, doc, hi - lo, shingle)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(sets, pa.list_(pa.int64()))], names=["k1", "k2", "set"])
        trim()

    k1, k2 = row_keys(id_col, text_col)
    d = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("t")).mapInArrow(run, "k1 long, k2 long, set array<long>")
    # rows of one id have the same keys: by all three, what the join has dealt by the keys is not dealt anew
    return d.join(ids, ["k1", "k2"]).dropDuplicates(["k1", "k2", "id"]).select("id", "set")


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, fp, near, bands, doc, k1, k2) of every row: a number of its own, size of the shingle set, fingerprint,
    near places of each segment, band codes, and the row's id and keys."""

    def run(batches):
        for b in batches:
            raw, offsets = string_buffers(b.column(1))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                doc, _, _, h = words(raw[part[0] : part[-1]], part - part[0], fold=LOWER)
                sets = shingle_sets(h, doc, hi - lo, shingle)
                fp, near, bands = zip(*(_prints(sets[i : i + 256]) for i in range(0, len(sets), 256)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for part in fp for x in part], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes() for part in parts for x in part], pa.binary()) for parts in (near, bands)),
                        *(b.column(i).slice(lo, hi - lo) for i in (2, 3, 4)),
                    ],
                    names=["id", "n", "fp", "near", "bands", "doc", "k1", "k2"],
                )
        trim()

    k1, k2 = row_keys(id_col, text_col)
    d = docs.select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("t"), F.col(id_col).cast("long").alias("doc"), k1.alias("k1"), k2.alias("k2"))
    return d.mapInArrow(run, "id long, n long, fp array<long>, near binary, bands binary, doc long, k1 long, k2 long")


def segment_keys(fp: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Keys of each segment's ball; the segment's number is in the high half of a key."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")[:, :KEYED]
    base = bits.reshape(-1, SEGMENTS, BITS).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64))
    base |= np.arange(SEGMENTS, dtype=np.int64) << 32
    flips = base[:, :, None] ^ (np.int64(1) << near.reshape(-1, SEGMENTS, NEAR).astype(np.int64))
    return np.concatenate([base[:, :, None], flips], axis=2).reshape(len(fp), -1)


def _slot(key):
    """Place of a key in the bitmap of repeated keys, of numbers as of Columns: segment and code mixed by shifts."""
    if isinstance(key, np.ndarray):
        code = key & 0xFFFFFFFF
        return (code ^ (code >> 13) ^ ((key >> 32) * 2097593)) & (SLOTS - 1)
    code = key.bitwiseAND(F.lit(0xFFFFFFFF))
    return code.bitwiseXOR(F.shiftright(code, 13)).bitwiseXOR(F.shiftright(key, 32) * 2097593).bitwiseAND(F.lit(SLOTS - 1))


def bitmap(slots: DataFrame) -> np.ndarray:
    """``SLOTS`` bits with those of ``slots(s)`` set. However many rows there are, the driver gets its words at most."""
    found = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("bits")).toArrow()
    words64 = np.zeros(SLOTS // 64, np.int64)
    words64[found["w"].to_numpy()] = found["bits"].to_numpy()
    return words64


def _set(words64: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words64[at >> 6] >> (at & 63)) & 1 == 1


def _key_rows(nodes: DataFrame, slots: np.ndarray | None = None) -> DataFrame:
    """(id, key) of every node; with ``slots`` those alone whose key can be a repeated one, before anything is shuffled."""
    held = None if slots is None else nodes.sparkSession.sparkContext.broadcast(slots)

    def out(ids, keys):
        if held is not None:
            some = _set(held.value, _slot(keys))
            ids, keys = ids[some], keys[some]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], names=["id", "key"])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                ids = c.column(0).to_numpy()
                codes = np.frombuffer(b"".join(c.column(4).to_pylist()), np.uint32).reshape(-1, BANDS)
                bands = codes.astype(np.int64) | (np.arange(SEGMENTS, SEGMENTS + BANDS, dtype=np.int64) << 32)
                yield out(np.repeat(ids, BANDS), bands.ravel())
                c = c.filter(pa.array(c.column(1).to_numpy() >= SHORT))
                if not c.num_rows:
                    continue
                fp = np.stack(c.column(2).to_numpy(zero_copy_only=False))
                near = np.frombuffer(b"".join(c.column(3).to_pylist()), np.uint8)
                keys = segment_keys(np.ascontiguousarray(fp, np.int64), near)
                yield out(np.repeat(c.column(0).to_numpy(), keys.shape[1]), keys.ravel())
        trim()

    return nodes.select("id", "n", "fp", "near", "bands").mapInArrow(run, "id long, key long")


def farthest(a, b, similarity: float):
    """Greatest distance at which sets of sizes a and b are verified; negative where their sizes forbid the similarity."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    cos = similarity / (1 + similarity) * (a + b) / np.sqrt(np.maximum(a * b, 1.0))
    most = np.where(low < SHORT, SIZE, SIZE * (np.arccos(np.minimum(cos, 1.0)) / np.pi + SLACK))
    return np.where(low >= similarity * high - EXACT, most, -1.0)


def _near(similarity: float):
    """``farthest`` and the complete distance as one Column over (an, afp, bn, bfp)."""
    d = sum((F.bit_count(F.col("afp")[i].bitwiseXOR(F.col("bfp")[i])) for i in range(1, WORDS64)), F.bit_count(F.col("afp")[0].bitwiseXOR(F.col("bfp")[0])))
    cos = F.lit(similarity / (1 + similarity)) * (F.col("an") + F.col("bn")) / F.sqrt(F.greatest(F.col("an") * F.col("bn"), F.lit(1)).cast("double"))
    most = F.lit(float(SIZE)) * (F.acos(F.least(cos, F.lit(1.0))) / math.pi + SLACK)
    low, high = F.least("an", "bn"), F.greatest("an", "bn")
    return (low >= similarity * high - EXACT) & ((low < SHORT) | (d <= most))


def _alike(similarity: float):
    """Whether the Jaccard similarity of (aset, bset) is at least ``similarity``, as one Column."""
    both = F.size(F.array_intersect("aset", "bset"))
    return both >= similarity * (F.size("aset") + F.size("bset") - both) - EXACT


def _block_links(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links that join the components of one block: minor members against all that share a key. Without sets the distance decides."""
    few, many = pdf[pdf["small"]], pdf[~pdf["small"]]
    out: list[tuple[int, int]] = []
    if len(few) and len(many):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        ids, comps, sizes = (many[c].to_numpy() for c in ("id", "comp", "n"))
        fps = np.stack(many["fp"].to_list()).view(np.uint64)
        keys = [set(np.asarray(x).tolist()) for x in many["keys"]]
        sets = [many["set"].to_numpy(), few["set"].to_numpy()] if "set" in pdf else None
        for k, (i, c, n, fp, mine) in enumerate(zip(few["id"].tolist(), few["comp"].tolist(), few["n"].tolist(), few["fp"], few["keys"])):
            at = np.flatnonzero(comps != c)
            d = np.bitwise_count(fps[at] ^ np.asarray(fp).view(np.uint64)).sum(1, dtype=np.int64)
            mine = np.asarray(mine).tolist()
            for h in at[d <= farthest(float(n), sizes[at].astype(float), similarity)].tolist():
                p, q = top(c), top(int(comps[h]))
                if p == q or keys[h].isdisjoint(mine):
                    continue
                if sets:
                    x, y = sets[0][h], sets[1][k]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both < similarity * (len(x) + len(y) - both) - EXACT:
                        continue
                up[max(p, q)] = min(p, q)
                out.append((i, int(ids[h])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _open_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with those of their ``keys`` alone that a minor row may have too; rows without any go."""
    keys = rows.where("comp != main").select(F.explode("keys").alias("key"))
    held = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(_slot(F.col("key")).alias("s"))))

    def run(batches):
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten()
            own = pa.array(np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()))
            some = _set(held.value, _slot(flat.to_numpy())) if len(flat) else np.zeros(0, bool)
            left = np.bincount(own.to_numpy()[some], minlength=b.num_rows)
            ends = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
            open_ = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(some)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), open_], names=["main", "id", "comp", "keys"]).filter(pa.array(left > 0))

    return rows.select("main", "id", "comp", "keys").mapInArrow(run, "main long, id long, comp long, keys array<long>")


def _rest(met: DataFrame, nodes: DataFrame, comp: DataFrame, similarity: float, scratch: Scratch, sets=None) -> DataFrame:
    """Links between the components of each bucket of three or more that holds more than one.

    ``sets`` gives (id, set) of a table of ids. A bucket goes to the component of its hub, its least member. Members of
    other components are minor, and each is compared with all members of buckets it is in. A text has hundreds of
    buckets, mostly of one component, so it is sent once to each component and not once to each bucket; components with more than
    ``WHOLE`` texts in their buckets are gone through bucket by bucket, lest each text of them meet all others.
    """
    if "hub" not in met.columns:
        met = met.join(met.groupBy("key").agg(F.min("id").alias("hub")), "key")
    of, hubs = comp.select(F.col("node").alias("id"), "root"), comp.select(F.col("node").alias("hub"), F.col("root").alias("top"))
    rows = met.groupBy("id", "hub").agg(F.collect_list("key").alias("keys")).join(of, "id", "left").join(hubs, "hub", "left")
    rows = rows.select(F.coalesce("top", "hub").alias("main"), "id", F.coalesce("root", "id").alias("comp"), "keys")
    rows = scratch.table(rows)
    rows = _open_keys(rows).groupBy("main", "id").agg(F.first("comp").alias("comp"), F.flatten(F.collect_list("keys")).alias("keys"))
    rows = scratch.table(rows)
    held = rows.groupBy("main").agg(F.count(F.lit(1)).alias("total"))
    large = held.where(F.col("total") > WHOLE).select("main")
    each = rows.join(large, "main", "left_semi").withColumn("bucket", F.explode("keys")).withColumn("keys", F.array("bucket"))
    rows = rows.join(large, "main", "left_anti").withColumn("bucket", F.lit(None).cast("long")).unionByName(each)
    # a bucket number of its own for what is gone through as a whole
    rows = scratch.table(rows.withColumn("bucket", F.coalesce("bucket", F.lit(-1))))
    minor = F.col("comp") != F.col("main")
    open_ = rows.groupBy("main", "bucket").agg(F.count(F.lit(1)).alias("total"), F.count_if(minor).alias("others")).where("others > 0 AND total > 1")
    if sets:
        wanted = nodes.join(rows.select("id").distinct(), "id", "left_semi").select("id", "k1", "k2")
        nodes = nodes.join(scratch.table(sets(wanted)), "id")
    rows = rows.join(open_, ["main", "bucket"]).join(nodes.select("id", "n", "fp", *(["set"] if sets else [])), "id")
    few, many = F.ceil(F.col("others") / MINOR).cast("int"), F.ceil(F.col("total") / MAJOR).cast("int")
    place, kept = F.xxhash64("id"), ["id", "comp", "n", "fp", "keys"] + (["set"] if sets else [])
    by = ["main", "bucket", "x", "y"]
    minor = rows.where(minor).select(
        "main", "bucket", F.pmod(place, few).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), many - 1)).alias("y"), F.lit(True).alias("small"), *kept
    )
    major = rows.select(
        "main", "bucket", F.explode(F.sequence(F.lit(0), few - 1)).alias("x"), F.pmod(place, many).cast("int").alias("y"), F.lit(False).alias("small"), *kept
    )
    links = minor.unionByName(major).groupBy(*by).applyInPandas(lambda pdf: _block_links(pdf, similarity), "a long, b long")
    return links.distinct()


def _joined(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the components of ``stars(a, b)``.

    A member of a large group has another hub in each of its buckets. Its least hub alone joins
    most of the group; of the other links only those between different components are left then,
    and they join the components' roots.
    """
    least = scratch.table(connected_components(stars.groupBy("a").agg(F.min("b").alias("b")), scratch))
    a, b = (least.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    between = (
        stars.join(a, "a", "left")
        .join(b, "b", "left")
        .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        .where("a != b")
        .distinct()
    )
    over = connected_components(between, scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # a hub that is nobody's least hub and has no link of its own is its own root so far
    ends = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    rooted = ends.join(least, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return scratch.table(rooted.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def hub_pairs(met: DataFrame) -> DataFrame:
    """(a, b, times) of ``met(id, key, c, hub)``: how often text a meets hub b in buckets of bands and in buckets of two, which ``_rest`` doesn't take."""
    some = met.where((F.col("id") != F.col("hub")) & ((F.shiftright("key", 32) >= SEGMENTS) | (F.col("c") == 2)))
    return some.groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("times"))


def similar_rows(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(doc, k1, k2, root) of every row, written: its id and keys, and a number that the rows of its group share."""
    all_ = scratch.table(wide_fingerprints(docs, id_col, text_col, shingle))
    nodes = scratch.table(all_.groupBy("fp", "n").agg(F.min(F.struct("id", "near", "bands", "k1", "k2")).alias("m")).select("m.*", "n", "fp"))
    shared = scratch.table(_key_rows(nodes).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("hub")).where("c > 1"))
    # few keys are repeated: the bitmap leaves out most rows before they are shuffled once more
    met = scratch.table(_key_rows(nodes, bitmap(shared.select(_slot(F.col("key")).alias("s")))).join(shared, "key"))
    a = nodes.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("fp").alias("afp"))
    b = nodes.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("fp").alias("bfp"))
    sets = lambda ids: shingle_rows(docs, scratch.table(ids), id_col, text_col, shingle)

    def linked(pairs: DataFrame) -> DataFrame:
        close = scratch.table(pairs.join(a, "a").join(b, "b").where(_near(similarity)).select("a", "b"))
        ends = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
        of = scratch.table(sets(nodes.join(ends, "id", "left_semi").select("id", "k1", "k2")))
        asets, bsets = (of.select(F.col("id").alias(x), F.col("set").alias(f"{x}set")) for x in ("a", "b"))
        got = scratch.table(close.join(asets, "a").join(bsets, "b").where(_alike(similarity)).select("a", "b").distinct())
        scratch.drop(of)
        return got

    pairs = scratch.table(hub_pairs(met))
    # the hub that a text meets most often joins most of its group: only pairs between what that has not joined are looked at
    most = scratch.table(pairs.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b")))
    first = linked(most)
    at = scratch.table(connected_components(first, scratch))
    at_a, at_b = (at.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    apart = pairs.join(at_a, "a", "left").join(at_b, "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    apart = scratch.table(apart.select("a", "b").join(most, ["a", "b"], "left_anti"))
    comp = _joined(scratch.table(first.unionByName(linked(apart))), scratch)
    rest = _rest(met.where("c > 2").select("key", "id", "hub"), nodes, comp, similarity, scratch, sets)
    edges = comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = scratch.table(connected_components(edges.unionByName(rest), scratch))
    # 128 bits stand for a fingerprint and size, which are too wide to shuffle for every row
    same = [F.xxhash64(F.lit(1), "n", "fp").alias("f1"), F.xxhash64("fp", "n", F.lit(2)).alias("f2")]
    rooted = nodes.select("id", *same).join(comp, nodes["id"] == comp["node"], "left").select("f1", "f2", F.coalesce("root", "id").alias("root"))
    out = scratch.table(all_.select("doc", "k1", "k2", *same).join(rooted, ["f1", "f2"]).select("doc", "k1", "k2", "root"))
    scratch.clear(out)
    return out


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row per input row: (id_col, component_id), the smallest id reachable by links.

    Texts link when the Jaccard similarity of their sets of lower-cased ``shingle``-word shingles
    is at least ``similarity``, and they share a key. Fewer words than a shingle count as one; texts without words are equal to each other and to nothing else, null counts as empty.
    Rows are grouped by themselves, not by their ids: a null id or one that different texts share joins nothing, and
    component_id is null only if every id of its group is. Equal fingerprints are one node, so copies are never expanded.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, BATCH_ROWS)
    rows = similar_rows(docs, scratch, id_col, text_col, shingle, similarity)
    least = scratch.table(rows.groupBy("root").agg(F.min("doc").alias("component_id")))
    return rows.join(least, "root").select(F.col("doc").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``: that of smallest id, null last, then of smallest key.

    Of rows with one id and text one stays, any of them if other columns differ. Rows are told apart by
    128 bits of hash of id and text, so different texts of one id are different documents.
    """
    scratch = Scratch(docs.sparkSession, BATCH_ROWS)
    rows = similar_rows(docs, scratch, id_col, text_col, shingle, similarity)
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "k1", "k2")
    per = rows.groupBy("k1", "k2").agg(F.min(order).alias("me"), F.min("root").alias("root"), F.count(F.lit(1)).alias("times"))
    per = scratch.table(per)
    stays = scratch.table(per.groupBy("root").agg(F.min("me").alias("first")))
    told = per.join(stays, "root").withColumn("stays", F.col("me") == F.col("first")).where("times > 1 OR NOT stays")
    k1, k2 = fresh(docs.columns, "__k1", "__k2")
    told = scratch.table(told.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "stays"))
    scratch.clear(told)
    # a bitmap of the keys tells most other rows apart where they are read: they stay and are not shuffled
    held = docs.sparkSession.sparkContext.broadcast(bitmap(told.select(F.col(k1).bitwiseAND(F.lit(SLOTS - 1)).alias("s"))))

    @F.pandas_udf("boolean")
    def may_go(key: pd.Series) -> pd.Series:
        return pd.Series(_set(held.value, key.to_numpy() & (SLOTS - 1)))

    keys = row_keys(id_col, text_col)
    once = docs.where(~may_go(keys[0]))
    some = docs.where(may_go(keys[0])).withColumns(dict(zip((k1, k2), keys)))
    # rows that are not told of are there once
    (stays,) = fresh([*docs.columns, k1, k2], "__stays")
    some = some.join(told.withColumnRenamed("stays", stays), [k1, k2], "left").where(F.coalesce(F.col(stays), F.lit(True))).dropDuplicates([k1, k2])
    return once.select(*docs.columns).unionByName(some.select(*docs.columns))
