"""Helpers shared by the training-data operators: scratch tables in the cluster's
shared folder, and a vectorised tokeniser over Arrow string buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a single-JVM local session (tests) may leave it unset; there a temporary
    folder stands in for it. On a cluster a missing setting is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="quire-"))
    return _LOCAL_ROOT[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    With ``batch_rows`` Python takes at most so many rows at a time while a table is written, since both sides hold a batch's texts.
    """

    def __init__(self, spark: SparkSession, batch_rows: int | None = None):
        self.spark, self.batch_rows = spark, batch_rows
        self.root = f"{scratch_root(spark)}/quire-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        rows = self.spark.conf.get(_BATCH)
        if self.batch_rows and not 0 < int(rows) <= self.batch_rows:
            self.spark.conf.set(_BATCH, str(self.batch_rows))
        try:
            df.write.parquet(path)
        finally:
            if self.spark.conf.get(_BATCH) != rows:
                self.spark.conf.set(_BATCH, rows)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, *keep: DataFrame) -> None:
        """Remove all tables written so far but ``keep``, once no later step reads the others."""
        kept = {f.rstrip("/").rsplit("/", 2)[1] for t in keep for f in t.inputFiles()}
        conf = self.spark._jsc.hadoopConfiguration()
        for n in range(1, self._n + 1):
            if str(n) not in kept:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
                path.getFileSystem(conf).delete(path, True)


def fresh(columns, *stems: str) -> list[str]:
    """Names that none of ``columns`` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for x in stems:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def trim() -> None:
    """Give freed memory back to the system: Python workers are kept for later tasks, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


# --- tokeniser -------------------------------------------------------------------------

#: Bytes that separate words under the contract pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII upper case to lower case, byte by byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes whose words are hashed at a time.
_WORDS_BLOCK = 1 << 18


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _PINV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """Row ranges of at most so many bytes, one row at least: bounds the temporaries."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray | None = None):
    """Words of documents that lie one after another in ``raw``.

    Returns (document index, start byte, end byte, 64-bit hash) of every word. A word is
    a maximal run of bytes outside ``sep`` within one document; ``fold`` maps the bytes
    before they are hashed.
    """
    parts, lo, n = [], 0, len(raw)
    while lo < n:
        # cut at a separator, so that temporaries stay small however long the texts are
        hi = n
        if n - lo > _WORDS_BLOCK:
            gap = np.flatnonzero(sep[raw[lo + _WORDS_BLOCK : lo + 2 * _WORDS_BLOCK]])
            hi = lo + _WORDS_BLOCK + int(gap[0]) if len(gap) else min(n, int(offsets[np.searchsorted(offsets, lo + _WORDS_BLOCK, "left")]))
        parts.append(_words(raw[lo:hi], offsets, lo, sep, fold))
        lo = hi
    if not parts:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    starts, ends, h = (np.concatenate(x) for x in zip(*parts))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, h


def _words(raw: np.ndarray, offsets: np.ndarray, at: int, sep: np.ndarray, fold: np.ndarray | None):
    """(start, end, hash) of the words of a part that begins at byte ``at`` of all texts; no word crosses its ends."""
    n = len(raw)
    inside = ~sep[raw]
    edge = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n, "right")] - at
    first = np.zeros(n + 1, bool)
    first[edge] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    pw, inv = powers(1 << max(12, int(n).bit_length()))
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw if fold is None else fold[raw]] * pw[:n], out=acc[1:])
    return starts + at, ends + at, mix((acc[ends] - acc[starts]) * inv[starts])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences that start at each word but the last k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)
