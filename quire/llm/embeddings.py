"""Embedding near-dedup by cross-polytope hashing.

Unit vectors are turned by three rounds of random signs and a fast Hadamard transform; a
hash of a vector is its nearest signed axis. A key joins as many hashes (the last one over
the first axes only) as give buckets of about ``OWN`` vectors, by the size of the vector's own label,
and there are as many tables as a simulation of pairs at the threshold needs to lose fewer than ``MISS``
of them. Each table probes the keys nearest to a vector (multiprobe). Buckets first compare
sign sketches of 256 bits, so that vectors travel only to buckets where they have a candidate;
there pairs, one of them in its own bucket, are verified by cosine in double precision. Buckets are cut into
blocks, and a task holds two blocks at a time. A pair that meets in several buckets is counted in the first of
them only, which both vectors' probe lists tell, so links are counted exactly and never written out as pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.components import connected_components

PROBES, MISS, OWN = 4, 0.001, 512
#: Rows of a bucket's block when sketches and when vectors are compared.
SKETCH_BLOCK, BLOCK = 2048, 512
#: 64-bit words of a sketch, and deviations by which its distance may exceed the one expected at the threshold.
SKETCH_WORDS, DEVIATIONS = 4, 6
_TABLE = 56


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _turned(v: np.ndarray, *seed: int, least: int = 16) -> np.ndarray:
    """Rows of ``v``, padded to a power of two of ``least`` at least, after a random rotation."""
    d = max(least, 1 << (v.shape[1] - 1).bit_length())
    x = np.zeros((len(v), d))
    x[:, : v.shape[1]] = v
    rng = np.random.default_rng([*seed, d])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def hash_axes(dim: int, bits: int) -> tuple[int, ...]:
    """Axes of each hash of a key with 2 ** bits values: whole ones, then one over the first axes."""
    whole = max(4, (dim - 1).bit_length()) + 1
    return (1 << (whole - 1),) * (bits // whole) + ((1 << (bits % whole - 1),) if bits % whole else ())


def probe_codes(v: np.ndarray, bits: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes) bucket codes of unit vectors, nearest first; the first of each is the own bucket."""
    out = np.full((len(v), tables, probes), -1, np.int64)
    for t in range(tables):
        cost = code = None
        for k, axes in enumerate(hash_axes(v.shape[1], bits)):
            r = _turned(v, t, k)[:, :axes]
            s = np.concatenate([r, -r], 1)
            near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(s, near, 1)
            gap = (value[:, :1] - value) ** 2
            if code is None:
                cost, code = gap, near.astype(np.int64)
                continue
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(v), -1)
            code = (code[:, :, None] * (2 * axes) + near[:, None, :]).reshape(len(v), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
        out[:, t, : code.shape[1]] = code | (np.int64(t) << np.int64(_TABLE))
    return out


@lru_cache(maxsize=256)
def tables_needed(dim: int, bits: int, threshold: float, probes: int = PROBES, miss: float = MISS) -> int:
    """Tables after which fewer than ``miss`` of pairs at the threshold have not met, by a simulation of one table."""
    n = 2000 if dim <= 256 else 1000
    a, r = np.random.default_rng([dim, bits]).normal(size=(2, n, max(2, dim)))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r -= (r * a).sum(1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    x, y = (probe_codes(v, bits, 1, probes)[:, 0] for v in (a, threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * r))
    apart = 1 - ((x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)).mean()
    # one pair in n counts as apart at least, and the estimate gets two deviations
    apart = min(0.99, max(apart, 1 / n) + 2 * np.sqrt(max(apart, 1 / n) / n))
    return max(2, min(120, int(np.ceil(np.log(miss) / np.log(apart)))))


def sketches(v: np.ndarray) -> np.ndarray:
    """(rows, SKETCH_WORDS) sign bits of a rotation."""
    bits = _turned(v, 1 << 20, least=64 * SKETCH_WORDS)[:, : 64 * SKETCH_WORDS] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def sketch_reach(threshold: float) -> float:
    """Sketch distance beyond which a pair cannot be at the threshold, but for chance of ``DEVIATIONS``."""
    n, p = 64 * SKETCH_WORDS, np.arccos(threshold) / np.pi
    return n * p + DEVIATIONS * np.sqrt(n * p * (1 - p))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _coded(batches, threshold: float):
    """Appends codes and sketch to rows (g, row, id, w, bits, vec)."""
    for b in batches:
        if not len(b):
            continue
        vec, bits = b.column(5), b.column(4).to_numpy()
        flat, off = vec.flatten().to_numpy(), np.asarray(vec.offsets)
        size = np.diff(off)
        codes, marks = [None] * len(b), [None] * len(b)
        for d, k in sorted(set(zip(size.tolist(), bits.tolist()))):
            for at in np.array_split(np.flatnonzero((size == d) & (bits == k)), -(-int((size == d).sum()) * d // 500_000) or 1):
                if not len(at):
                    continue
                x = _unit(flat[(off[at] - off[0])[:, None] + np.arange(d)])
                found = probe_codes(x, k, tables_needed(d, k, threshold)).reshape(len(at), -1)
                for r, c, s in zip(at.tolist(), found, sketches(x)):
                    codes[r], marks[r] = c, s.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=[*b.schema.names, "codes", "sketch"])


def _by_unit(batches):
    """The rows of each unit (g, tc, x, y), as tables; batches come sorted by unit."""
    held = None

    def key(t):
        return np.stack([t.column(c).to_numpy() for c in ("g", "tc", "x", "y")], 1)

    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        k = key(held)
        edge = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for s, e in zip([0, *edge[:-1].tolist()], edge.tolist()):
            yield held.slice(s, e - s)
        if len(edge):
            held = held.slice(edge[-1])
    if held is not None and len(held):
        yield held


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    home = t.column("home").to_numpy(zero_copy_only=False)
    return np.flatnonzero(home), np.flatnonzero(~home)


def _candidates(batches, reach: float):
    """(g, tc, row, own) of the rows with a candidate in the bucket, by their sketches."""
    g, tc, row, own = [], [], [], []

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in ((g, pa.int64()), (tc, pa.int64()), (row, pa.int64()), (own, pa.bool_()))], names=["g", "tc", "row", "own"])
        for v in (g, tc, row, own):
            v.clear()
        return out

    for t in _by_unit(batches):
        a, b = _sides(t)
        if not len(a) or not len(b):
            continue
        rows, owns = t.column("row").to_numpy(), t.column("own").to_numpy(zero_copy_only=False)
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), -1)
        some = np.zeros(len(t), bool)
        for lo in range(0, len(a), 128):
            i = a[lo : lo + 128]
            near = np.bitwise_count(marks[i][:, None, :] ^ marks[b][None, :, :]).sum(2, dtype=np.int64) <= reach
            near &= rows[i][:, None] != rows[b][None, :]
            some[i] |= near.any(1)
            some[b] |= near.any(0)
        at = np.flatnonzero(some)
        n = len(at)
        g += [t.column("g")[0].as_py()] * n
        tc += [t.column("tc")[0].as_py()] * n
        row += rows[at].tolist()
        own += owns[at].tolist()
        if len(g) > 100_000:
            yield batch()
    if g:
        yield batch()


def _links(batches, threshold: float):
    """(a, n, b): link weights n of class a met first in a unit, and edges (a, b) that join what is linked there."""
    a_out, n_out, b_out = [], [], []

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a_out, n_out, b_out)], names=["a", "n", "b"])
        for v in (a_out, n_out, b_out):
            v.clear()
        return out

    for t in _by_unit(batches):
        mine, all_ = _sides(t)
        if not len(mine) or not len(all_):
            continue
        vec = t.column("vec").combine_chunks() if isinstance(t.column("vec"), pa.ChunkedArray) else t.column("vec")
        x = _unit(_matrix(vec))
        rows, w, owns = t.column("row").to_numpy(), t.column("w").to_numpy(), t.column("own").to_numpy(zero_copy_only=False)
        tc = t.column("tc")[0].as_py()
        linked = x[mine] @ x[all_].T >= threshold
        # two members of the bucket meet from both sides: the smaller counts them
        linked &= np.where(owns[all_][None, :], rows[mine][:, None] < rows[all_][None, :], rows[mine][:, None] != rows[all_][None, :])
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        codes = t.column("codes").combine_chunks()
        p = _matrix(codes).reshape(len(t), -1, PROBES)
        first = np.zeros(len(i), bool)
        none = np.iinfo(np.int64).max
        for c in range(0, len(i), 20_000):
            u, v = p[mine[i[c : c + 20_000]]], p[all_[j[c : c + 20_000]]]
            uv = np.where((v == u[:, :, :1]).any(2), u[:, :, 0], none)
            vu = np.where((u == v[:, :, :1]).any(2), v[:, :, 0], none)
            first[c : c + 20_000] = np.minimum(uv.min(1), vu.min(1)) == tc
        i, j = i[first], j[first]
        if not len(i):
            continue
        linked = np.zeros(linked.shape, bool)
        linked[i, j] = True
        count = np.bincount(mine[i], w[all_[j]], len(t)) + np.bincount(all_[j], w[mine[i]], len(t))
        low, high = rows[mine].copy(), rows[all_].copy()
        while True:
            down = np.minimum(low, np.where(linked, high[None, :], none).min(1))
            up = np.minimum(high, np.where(linked, down[:, None], none).min(0))
            if (down == low).all() and (up == high).all():
                break
            low, high = down, up
        root = np.empty(len(t), np.int64)
        root[mine], root[all_] = low, high
        at = np.flatnonzero(count)
        a_out += rows[at].tolist()
        n_out += count[at].astype(np.int64).tolist()
        b_out += root[at].tolist()
        if len(a_out) > 100_000:
            yield batch()
    if a_out:
        yield batch()


def _units(members: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Members (g, tc, row, own, ...) of each bucket dealt to units: a block of its own vectors (``home``) and a block of all."""
    per = members.groupBy("g", "tc").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("o")).where("o > 0 AND n > 1")
    # written, so that the join may split a bucket with very many members
    met = members.join(scratch.table(per), ["g", "tc"])
    few, many = F.ceil(F.col("o") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    copies = F.concat(
        F.when(
            F.col("own"),
            F.transform(F.sequence(F.lit(0), many - 1), lambda y: F.struct(F.pmod(F.xxhash64("row", F.lit(1)), few).cast("int").alias("x"), y.alias("y"), F.lit(True).alias("home"))),
        ).otherwise(F.array().cast("array<struct<x:int,y:int,home:boolean>>")),
        F.transform(F.sequence(F.lit(0), few - 1), lambda x: F.struct(x.alias("x"), F.pmod(F.xxhash64("row", F.lit(2)), many).cast("int").alias("y"), F.lit(False).alias("home"))),
    )
    return met.withColumn("c", F.explode(copies)).select("*", "c.*").drop("c", "n", "o")


def _sorted_units(units: DataFrame) -> DataFrame:
    return units.repartition("g", "tc", "x", "y").sortWithinPartitions("g", "tc", "x", "y")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null, their dimensions agree and their
    cosine is at least ``threshold``. n_links counts the other vectors linked directly,
    component_id is the smallest id reachable, kept tells that it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing. Equal
    vectors are one node with a weight, so copies are never compared. A repeated row is counted
    once and returned each time; different vectors that share an id are different vectors; a null id is
    nobody's link and is returned with n_links 0 and null component_id and kept. Other columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(F.col(vec_col).cast(kind), lambda x: x + zero).alias("vec"))
    # the vector is named by 128 bits of hash; adding zero has made -0.0 and 0.0 one
    rows = rows.withColumns({"h1": F.xxhash64("label", "vec"), "h2": F.xxhash64("vec", F.lit(2), "label")})
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    good = rows.where(sound).where((F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0))
    weights = good.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    classes = good.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec")).join(weights, ["h1", "h2"])
    classes = scratch.table(classes.withColumns({"dim": F.size("vec"), "row": F.monotonically_increasing_id()}))
    bits = F.greatest(F.lit(3), F.ceil(F.log2(F.col("n") / OWN)).cast("int"))
    groups = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select("label", "dim", bits.alias("bits"), F.monotonically_increasing_id().alias("g"))
    groups = scratch.table(groups)
    keyed = classes.join(groups, ["label", "dim"]).select("g", "row", "id", "w", "bits", "vec")
    nodes = scratch.table(keyed.mapInArrow(lambda it: _coded(it, threshold), f"g long, row long, id long, w long, bits int, vec {kind}, codes array<long>, sketch binary"))
    slim = nodes.select("g", "row", "sketch", F.posexplode("codes").alias("at", "tc")).where("tc >= 0")
    slim = slim.select("g", "tc", "row", (F.col("at") % PROBES == 0).alias("own"), "sketch")
    reach = sketch_reach(threshold)
    found = _sorted_units(_units(slim, scratch, SKETCH_BLOCK)).select("g", "tc", "x", "y", "home", "row", "own", "sketch")
    live = found.mapInArrow(lambda it: _candidates(it, reach), "g long, tc long, row long, own boolean")
    live = scratch.table(live.groupBy("g", "tc", "row").agg(F.max("own").alias("own")))
    wide = _units(live, scratch, BLOCK).join(nodes.select("row", "w", "vec", "codes"), "row")
    met = _sorted_units(wide).select("g", "tc", "x", "y", "home", "row", "own", "w", "vec", "codes")
    met = scratch.table(met.mapInArrow(lambda it: _links(it, threshold), "a long, n long, b long"))
    comp = connected_components(met.select("a", "b"), scratch)
    links = met.groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n"))
    slim_classes = classes.select("row", "h1", "h2", "id", "w").join(comp.withColumnRenamed("node", "row"), "row", "left").join(links, "row", "left")
    slim_classes = scratch.table(slim_classes.select("h1", "h2", "id", F.coalesce("root", "row").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    least = scratch.table(slim_classes.groupBy("root").agg(F.min("id").alias("component_id")))
    by_class = scratch.table(slim_classes.join(least, "root").select("h1", "h2", "n_links", "component_id"))
    usable = F.col("id").isNotNull()
    out = rows.select("id", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    out = out.select(
        F.col("id").alias(id_col),
        F.when(usable, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(usable, F.coalesce("component_id", "id")).alias("component_id"),
    )
    scratch.drop(classes, nodes, live, met, slim_classes, least)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
