"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is cut into blocks of bounded size; each block's seed index is broadcast and
the corpus streams past it once, so no text is shuffled. The seed at each word of an item is the shortest
n-gram from there, of two words or more, that few items of the block hold: common pairs of words are extended until
they are rare. A cut by document frequency would drop just those n-grams that an edited passage in many documents
has left. Documents that share enough seeds with an item, in one place, are aligned with it there if enough of its
words are near for the least score, and the alignment score decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, Scratch, grams, slices, string_buffers, trim, words

#: Words are runs of ASCII letters, digits and non-ASCII bytes, in lower case.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False

#: Least and greatest words of a seed, and items that may hold a seed of less than the greatest size.
SEED_WORDS, LONGEST_SEED, RARE = 2, 6, 16
#: A place needs one in so many of an item's seeds, one at least.
SEED_SHARE = 8
BLOCK_WORDS = 500_000
#: Rows that Python takes at a time where it hands them back.
BATCH_ROWS = 1000
FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"


@dataclass(frozen=True)
class Index:
    """Sorted distinct n-gram hashes of one size, with the items and places that hold each."""

    gram: np.ndarray
    first: np.ndarray  # start of each n-gram's places
    item: np.ndarray
    pos: np.ndarray
    filter: np.ndarray  # bool, by the top 20 bits

    @classmethod
    def of(cls, gram, item, pos) -> Index:
        order = np.argsort(gram, kind="stable")
        uniq, first = np.unique(gram[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[(uniq >> np.uint64(44)).astype(np.int64)] = True
        return cls(uniq, np.append(first, len(gram)), item[order], pos[order], bits)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into h, item, place in the item) of all n-grams of h that the index holds."""
        at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        if len(at):
            s = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
            ok = self.gram[s] == h[at]
            at, s = at[ok], s[ok]
        if not len(at):
            return at, at, at
        reps = self.first[s + 1] - self.first[s]
        k = np.repeat(self.first[s], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        return np.repeat(at, reps), self.item[k], self.pos[k]


@dataclass(frozen=True)
class Block:
    """A part of the benchmark: distinct items with their ids, words' hashes and seeds."""

    ids: list  # of each distinct item, all its ids
    words: list  # uint64 arrays
    seeds: dict  # size -> Index
    need: np.ndarray  # seeds that a place needs, by item
    short: dict  # size -> Index of whole items with fewer words than a seed and one more


def _block(items: dict) -> Block:
    tokens = [np.frombuffer(k, np.uint64) for k in items]
    seeds, short = {}, {}
    number = np.zeros(len(tokens), np.int64)
    todo = [np.ones(max(0, len(w) - SEED_WORDS + 1), bool) if len(w) > SEED_WORDS else np.zeros(0, bool) for w in tokens]
    for n in range(SEED_WORDS, LONGEST_SEED + 1):
        g, i, p = [], [], []
        for k, w in enumerate(tokens):
            at = np.flatnonzero(todo[k][: max(0, len(w) - n + 1)])
            g.append(grams(w, n)[at])
            i.append(np.full(len(at), k))
            p.append(at)
        g, i, p = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((g, np.uint64), (i, np.int64), (p, np.int64)))
        if not len(g):
            continue
        _, which = np.unique(g, return_inverse=True)
        holders = np.bincount(np.unique(np.stack([which, i]), axis=1)[0])[which]
        # the last n-gram of an item has no longer one from its place
        end = p + n == np.array([len(w) for w in tokens])[i]
        ok = (holders <= RARE) | (n == LONGEST_SEED) | end
        if ok.any():
            seeds[n] = Index.of(g[ok], i[ok], p[ok])
            number += np.bincount(i[ok], minlength=len(tokens))
            for k, at in zip(i[ok].tolist(), p[ok].tolist()):
                todo[k][at] = False
    for n in range(1, SEED_WORDS + 1):
        at = np.array([k for k, w in enumerate(tokens) if len(w) == n], np.int64)
        if len(at):
            short[n] = Index.of(np.concatenate([grams(tokens[k], n) for k in at]), at, np.zeros(len(at), np.int64))
    return Block(list(items.values()), tokens, seeds, np.maximum(1, number // SEED_SHARE), short)


def _tokens(column: pa.Array):
    """For slices of a text column: (first row, word offsets by row, word hashes)."""
    raw, off = string_buffers(column)
    for lo, hi in slices(off):
        o = off[lo : hi + 1] - off[lo]
        doc, _, _, h = words(raw[off[lo] : off[hi]], o, NOT_WORD, LOWER)
        yield lo, np.searchsorted(doc, np.arange(hi - lo + 1)), h


def _places(index: Index, n: int, bounds: np.ndarray, h: np.ndarray):
    """(row, word, item, place in the item) of the n-grams of documents that the index holds."""
    where, item, pos = index.places(grams(h, n))
    row = np.searchsorted(bounds, where, "right") - 1
    ok = where + n <= bounds[row + 1]
    return row[ok], where[ok], item[ok], pos[ok]


def smith_waterman(a: np.ndarray, b: np.ndarray, b_len: np.ndarray, match=2, mismatch=-1, gap=-1):
    """Best local alignment of sequence ``a`` with each row of ``b`` (n, width).

    Returns (score, end) with end exclusive in b. A row's places from its length on match nothing.
    """
    n, width = b.shape
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = -gap * np.arange(width + 1, dtype=np.int32)
    live = np.arange(width)[None, :] < b_len[:, None]
    for x in a:
        s = np.where((b == x) & live, match, mismatch)
        t = np.zeros_like(h)
        np.maximum(h[:, :-1] + s, h[:, 1:] + gap, out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        top = h[:, 1:].argmax(1)
        value = h[np.arange(n), top + 1]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def _may_reach(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Rows of b that hold the words of at least ``least`` places of a; an alignment matches no other place."""
    known, times = np.unique(a, return_counts=True)
    at = np.minimum(np.searchsorted(known, b), len(known) - 1)
    row, col = np.nonzero(known[at] == b)
    held = np.zeros((len(b), len(known)), bool)
    held[row, at[row, col]] = True
    return held @ times >= least


def _align(block: Block, bounds, h, min_score: float):
    """(row, item, score, first word, last word + 1) of the passages of documents that copy an item."""
    out = []
    for n, index in block.short.items():
        row, word, item, _ = _places(index, n, bounds, h)
        for d, w, i in zip(row.tolist(), (word - bounds[row]).tolist(), item.tolist()):
            out.append((d, i, 1.0, w, w + n))
    got = [_places(index, n, bounds, h) for n, index in block.seeds.items()]
    if not got:
        return out
    doc, where, item, pos = (np.concatenate(x) for x in zip(*got))
    if not len(doc):
        return out
    diag = where - pos
    order = np.lexsort((diag, item, doc))
    doc, item, diag = doc[order], item[order], diag[order]
    size = np.array([len(w) for w in block.words])
    slack = np.maximum(4, size // 4)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > slack[item[1:]])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(doc))
    many = stop - start >= block.need[item[start]]
    todo: dict[int, list] = {}
    for s, e in zip(start[many].tolist(), stop[many].tolist()):
        i = int(item[s])
        d = int(doc[s])
        lo = max(int(bounds[d]), int(diag[s]) - int(slack[i]))
        hi = min(int(bounds[d + 1]), int(diag[e - 1]) + int(size[i] + slack[i]))
        # a long run of diagonals is aligned in overlapping windows, each a few items wide
        wide = 4 * int(size[i]) + 2 * int(slack[i])
        while hi - lo > wide:
            todo.setdefault(i, []).append((d, lo, lo + wide))
            lo += wide - int(size[i] + slack[i])
        todo.setdefault(i, []).append((d, lo, hi))
    for i, places in todo.items():
        a = block.words[i]
        for c in range(0, len(places), 128):
            part = places[c : c + 128]
            n = np.array([hi - lo for _, lo, hi in part])
            b = np.zeros((len(part), n.max()), np.uint64)
            for r, (_, lo, hi) in enumerate(part):
                b[r, : hi - lo] = h[lo:hi]
            near = np.flatnonzero(_may_reach(a, b, min_score * len(a)))
            if not len(near):
                continue
            part, n, b = [part[r] for r in near], n[near], b[near]
            back = np.zeros_like(b)
            score, end = smith_waterman(a, b, n)
            ok = np.flatnonzero(score >= min_score * 2 * len(a))
            if not len(ok):
                continue
            for r in ok:
                back[r, : end[r]] = b[r, : end[r]][::-1]
            _, tail = smith_waterman(a[::-1], back[ok], end[ok])
            for r, t in zip(ok, tail):
                d, lo, _ = part[r]
                first = lo + int(end[r]) - int(t) - int(bounds[d])
                out.append((d, i, float(score[r]) / (2 * len(a)), first, lo + int(end[r]) - int(bounds[d])))
    return out


def contaminated_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_score: float = 0.5,
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): passages that copy a benchmark item.

    score is the Smith-Waterman score (match 2, mismatch and gap -1) over that of the item with
    itself; passages at ``min_score`` or more that share a seed are returned, overlapping ones of one item in one
    document once, with the best score. Words are counted from 0 in the document, end exclusive.
    Items of one or two words are matched whole, those without a word and null ones match nothing, as do null texts. Rows with
    a null id are searched like any other and returned under a null id, their passages merged; repeated rows give the same passages and are merged; other
    columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    result = None
    for seeds in _blocks(items, item_col, item_text_col):

        def search(batches, seeds=seeds):
            block = seeds.value
            for batch in batches:
                for lo, bounds, h in _tokens(batch.column(1)):
                    found = [(lo + r, i, *x) for r, k, *x in _align(block, bounds, h, min_score) for i in block.ids[k]]
                    if found:
                        r, i, score, first, last = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(score), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                            names=["doc_id", "item_id", "score", "start_word", "end_word"],
                        )

        part = d.mapInArrow(search, FOUND)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], FOUND) if result is None else _merged(result)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``contaminated_passages`` finds a passage in, judged row by row, whatever their ids or the items'.

    What is left is written to the shared folder, so that Python takes few rows at a time: both sides hold a batch's texts and what is kept of them.
    """
    scratch = Scratch(docs.sparkSession, BATCH_ROWS)
    items = items.select(F.lit(0).alias(item_col), item_text_col)
    at = docs.columns.index(text_col)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for seeds in _blocks(items, item_col, item_text_col):

        def clean(batches, seeds=seeds):
            # what an earlier task of this worker has left
            trim()
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for lo, bounds, h in _tokens(batch.column(at)):
                    keep[[lo + x[0] for x in _align(seeds.value, bounds, h, min_score)]] = False
                yield batch.filter(pa.array(keep))
            trim()

        docs = scratch.table(docs.mapInArrow(clean, kind))
    return docs


def _merged(found: DataFrame) -> DataFrame:
    """One row for passages that overlap: those that windows or repeated rows found again."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "item_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("start_word") >= reach).cast("int"), F.lit(0))
    return (
        found.distinct()
        .withColumn("apart", apart)
        .withColumn("part", F.sum("apart").over(w))
        .groupBy("doc_id", "item_id", "part")
        .agg(
            F.max("score").alias("score"),
            F.max_by("start_word", F.struct("score", -F.col("start_word"))).alias("start_word"),
            F.max_by("end_word", F.struct("score", -F.col("start_word"))).alias("end_word"),
        )
        .drop("part")
    )


def _blocks(items: DataFrame, item_col: str, text_col: str):
    """Broadcast blocks of about ``BLOCK_WORDS`` words; the benchmark is streamed to the driver, never held whole."""
    spark = items.sparkSession
    held, size = {}, 0
    for r in items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null").toLocalIterator():
        for _, _, h in _tokens(pa.array([r["t"]], pa.string())):
            if len(h):
                ids = held.setdefault(h.tobytes(), [])
                size += 0 if ids else len(h)
                if r["id"] not in ids:
                    ids.append(r["id"])
        if size >= BLOCK_WORDS:
            yield spark.sparkContext.broadcast(_block(held))
            held, size = {}, 0
    if held:
        yield spark.sparkContext.broadcast(_block(held))
