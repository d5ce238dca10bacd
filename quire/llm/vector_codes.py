"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

For a block of b components with sums S and residual norms r (the norm of what is left when the block's mean is
taken off), the squared distance of two blocks is at least (Sx - Sc)^2 / b + (rx - rc)^2. Summed over ever
finer blocks the bound only rises. Entries whose bound exceeds the exact distance of the most promising entry are
left out; the others get exact integer distances. Rounding is allowed for in the bound, so filtering loses no entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Scratch

#: Components become floor(SCALE * x).
SCALE = 256
#: Integer components are held within this, so that no squared distance of up to 2**15 components leaves 64 bits.
LIMIT = 1 << 23
#: Share of the squared norms allowed for rounding in a bound.
SLACK = 1e-10
#: Distances from a block of vectors to all entries of one part that are held at a time.
CELLS = 1 << 18
#: Labels whose sums are broadcast to the rows; with more, rows and sums meet by a shuffle.
BROADCAST_LABELS = 1 << 17


def _levels(width: int) -> list[np.ndarray]:
    """Block starts, from one block of all components to blocks of two."""
    out, blocks = [np.zeros(1, np.int64)], 2
    while width // blocks >= 2:
        out.append(np.arange(blocks, dtype=np.int64) * width // blocks)
        blocks *= 2
    return out


def _shape(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums divided by the root of the block size, residual norms, squared norm) of every row's blocks."""
    size = np.diff(np.append(starts, x.shape[1]))
    f = x.astype(float)
    sums = np.add.reduceat(f, starts, 1)
    rest = f - np.repeat(sums / size, size, 1)
    return sums / np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, starts, 1)), (f * f).sum(1)


@dataclass(frozen=True)
class Codebook:
    """The entries of one part, with the shapes of their blocks at every level."""

    entries: np.ndarray  # (entries, width) int64
    shapes: tuple

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        return Codebook(entries, tuple((s, *_shape(entries, s)) for s in _levels(entries.shape[1])))

    def nearest(self, x: np.ndarray, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lower index of equally near ones.

        ``tally`` collects how many entries got an exact distance, the promising ones not counted.
        """
        starts, at, norm, square = self.shapes[0]
        a, r, q = _shape(x, starts)
        low = (a - at[:, 0]) ** 2 + (r - norm[:, 0]) ** 2
        slack = SLACK * (q[:, None] + square)
        first = low.argmin(1)
        best = ((x - self.entries[first]) ** 2).sum(1)
        row, col = np.nonzero(low - slack <= best[:, None])
        for starts, at, norm, _ in self.shapes[1:]:
            a, r, _ = _shape(x, starts)
            low = ((a[row] - at[col]) ** 2 + (r[row] - norm[col]) ** 2).sum(1)
            near = low - slack[row, col] <= best[row]
            row, col = row[near], col[near]
        if tally is not None:
            tally.append(len(row))
        exact = ((x[row] - self.entries[col]) ** 2).sum(1)
        begin = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, begin)
        # pairs lie in order of row and entry, so the first of the least has the lower index
        hit = np.flatnonzero(exact == best[row])
        return col[hit[np.searchsorted(row[hit], np.arange(len(x)))]], best


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) integer components; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = np.floor(x * SCALE)
    return np.clip(out, -LIMIT, LIMIT).astype(np.int64)


def _blocks(batch: pa.RecordBatch, at: int, width: int, entries: int):
    """(first row, integer components) of blocks of rows: bounds the temporaries."""
    most = max(1, CELLS // max(entries, width))
    for lo in range(0, batch.num_rows, most):
        yield lo, _integers(batch.column(at).slice(lo, most), width)


def _assign(books: list[Codebook], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of each row's parts."""
    step = x.shape[1] // len(books)
    found = [b.nearest(x[:, i * step : (i + 1) * step]) for i, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def compress_vectors(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: its id, code, error, label_error and codebooks_sha256.

    Vectors that are null or hold a null or a non-finite component are dropped. Components become
    floor(256 * x), held within 2^23 either way. Shorter vectors count as filled up with zeros to the longest
    one's length, and all to a multiple of ``parts``; empty vectors are such too. The codebooks start as the parts of the
    vectors of the ``entries`` smallest ids, repeated rows each by themselves, rows of one id in the order of their components, null ids last; with fewer vectors
    they have fewer entries. Each round assigns every part, then replaces each entry by the componentwise floor of its parts' mean;
    entries without parts stay. Of equally near entries the lower index wins. Null labels share one sum; a sum beyond 64
    bits is null. Rows with null ids are encoded like others. Other columns are not returned and may have any name. No kept vector, no row.

    Sums of the parts are combined in each task before they are shuffled, so what the driver gathers is of the codebooks'
    size; codebooks are all that is broadcast but for the sums of few labels.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: entries must be 1 to 256")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~bad)
    seeds = [r["v"] for r in kept.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts)) * parts
    fields = [T.StructField(id_col, kept.schema["i"].dataType), T.StructField("__label", kept.schema["l"].dataType)]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not seeds:
        out = spark.createDataFrame([], schema).withColumn("label_error", F.col("error"))
        return out.drop("__label").withColumn("codebooks_sha256", F.lit(None).cast("string"))
    first = _integers(pa.array(seeds, pa.list_(pa.float64())), width)
    step, n = width // parts, len(first)
    book = np.stack([first[:, p * step : (p + 1) * step] for p in range(parts)])  # (parts, entries, width of a part)

    def sums(shared):
        def run(batches):
            books = shared.value
            total, count = np.zeros((parts, n, step), np.int64), np.zeros((parts, n), np.int64)
            for batch in batches:
                for _, x in _blocks(batch, 0, width, n):
                    code, _ = _assign(books, x)
                    for p in range(parts):
                        count[p] += np.bincount(code[:, p], minlength=n)
                        for j in range(step):
                            # a block's sum is below 2**53, so adding in doubles is exact
                            total[p, :, j] += np.bincount(code[:, p], x[:, p * step + j], n).astype(np.int64)
            used = np.flatnonzero(np.repeat(count.ravel() > 0, step))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(total.ravel()[used]), pa.array(np.repeat(count.ravel(), step)[used])], names=["k", "s", "c"]
            )

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast([Codebook.of(b) for b in book])
        by = kept.select("v").mapInArrow(sums(shared), "k long, s long, c long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        flat = book.ravel().copy()
        for r in by.collect():
            flat[r["k"]] = r["s"] // r["c"]
        book = flat.reshape(book.shape)
        shared.unpersist()
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    final = spark.sparkContext.broadcast([Codebook.of(b) for b in book])

    def encode(batches):
        for batch in batches:
            for lo, x in _blocks(batch, 2, width, n):
                code, error = _assign(final.value, x)
                digits = code.astype(np.uint8).tobytes().hex()
                codes = [digits[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(x))]
                rows = batch.slice(lo, len(x))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(error.sum(1))], names=schema.names)

    coded = scratch.table(kept.mapInArrow(encode, schema))
    by = scratch.table(coded.groupBy("__label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("__label", "__of"))
    few = by.count() <= BROADCAST_LABELS
    out = coded.join(F.broadcast(by) if few else by, F.col("__label").eqNullSafe(F.col("__of")))
    return out.select(id_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
