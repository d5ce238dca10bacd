"""Sums of weighted postings for many queries over a block of documents, inside a task.

Queries travel in blocks of bounded size. A pair of query and document is a cell of an array that a block of both fills, never a row: only
the block's best cells are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.io import new_folder

#: Terms of all queries of one block.
BLOCK_TERMS = 3_000_000
#: Cells of queries by documents that are held at a time, and postings that are added at a time.
CELLS = 1 << 18
#: Groups of documents, of whose cells the best is looked at first.
WIDE = 128
#: Share of a term's cells with a posting, from which all are multiplied.
COMMON = 0.003
#: Pairs whose common terms are looked up at a time.
PAIRS = 1 << 13
#: Scores nearer than this may be equal after rounding to 9 places.
NEAR = 2e-9


@dataclass(frozen=True)
class Queries:
    """A block of queries: their keys, distinct terms, and each query's (term, weight) pairs one after another."""

    keys: pa.Array
    terms: pa.Array
    first: np.ndarray  # start of each query's pairs
    term: np.ndarray
    weight: np.ndarray
    avgdl: float

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        """From rows (q, term, w) of distinct q and term, and the documents' mean length in ``avgdl`` if there."""
        q, t = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("q", "term"))
        avgdl = rows.column("avgdl")[0].as_py() if "avgdl" in rows.column_names and len(rows) else 0.0
        number = q.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(q.dictionary)))])
        return cls(q.dictionary, t.dictionary, first, t.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), rows.column("w").to_numpy()[order], avgdl)

    def find(self, terms: pa.Array) -> np.ndarray:
        """The number of each of ``terms``, -1 for one of no query."""
        return pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def query_blocks(weighted: DataFrame) -> list:
    """Broadcast blocks of ``weighted(q, term, w)``, about ``BLOCK_TERMS`` rows each; a query's rows are in one block.

    Several blocks are cut from a table in the shared folder, which is written once.
    """
    spark = weighted.sparkSession
    path = new_folder(spark, "queries")
    weighted.write.parquet(path)
    held = spark.read.schema(weighted.schema).parquet(path)
    n = -(-held.count() // BLOCK_TERMS)
    parts = [held if n == 1 else held.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i) for i in range(n)]
    return [spark.sparkContext.broadcast(Queries.of(p.toArrow())) for p in parts]


def ordered(docs: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each row's document, documents): numbers follow the order of keys, null first, text by its bytes."""
    d = docs.dictionary_encode("encode")
    order = pc.sort_indices(d.dictionary, null_placement="at_start").to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number[d.indices.to_numpy(zero_copy_only=False)], d.dictionary.take(pa.array(order))


def best(queries: Queries, n_docs: int, term: np.ndarray, doc: np.ndarray, value: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of each query's ``k`` best documents with a score above 0, ties by document.

    ``term``, ``doc`` and ``value`` are the postings, each pair of term and document once; a score is the sum of weight times value.
    With ``least``, a score for each query, documents below it may be left out. All cells are summed in single precision, where a term
    that many queries and documents hold is multiplied as a whole and the others are added posting by posting; cells that are not
    worse than the ``k``-th by more than the error of that are summed again in double precision.
    """
    n_q, width = len(queries.keys), -(-max(n_docs, 1) // WIDE) * WIDE
    order = np.argsort(term, kind="stable")
    term, doc, value = term[order], doc[order], value[order]
    single = value.astype(np.float32)
    df = np.bincount(term, minlength=len(queries.terms))
    start = np.concatenate([[0], np.cumsum(df)])
    held = np.flatnonzero(df)
    most = np.zeros(len(df))
    if len(held):
        most[held] = np.maximum.reduceat(np.abs(value), start[held])
    share = np.bincount(queries.term, minlength=len(df)) / max(n_q, 1) * (df / width)
    common = np.flatnonzero(share > COMMON)
    place = np.full(len(df), -1)
    place[common] = np.arange(len(common))
    dense = np.zeros((len(common), width))
    for i, t in enumerate(common):
        dense[i, doc[start[t] : start[t + 1]]] = value[start[t] : start[t + 1]]
    rough, dense = dense.astype(np.float32), dense.T.copy()
    size = np.diff(queries.first)
    owner = np.repeat(np.arange(n_q), size)
    error = np.bincount(owner, np.abs(queries.weight) * most[queries.term], n_q) * (size + 4) * 2.0**-23 + NEAR
    least = np.zeros(n_q) if least is None else least
    step, out = max(1, CELLS // width), []
    mark = np.zeros(step * width, np.int32)
    for lo in range(0, n_q, step):
        hi = min(n_q, lo + step)
        at = slice(queries.first[lo], queries.first[hi])
        t, w, row = queries.term[at], queries.weight[at], owner[at] - lo
        whole = place[t] >= 0
        part = np.zeros((hi - lo, len(common)))
        part[row[whole], place[t[whole]]] = w[whole]
        cells = part.astype(np.float32) @ rough
        some = np.flatnonzero(~whole & (df[t] > 0))
        row, t, w = row[some], t[some], w[some]
        # what fits at a time is gone through twice, more is listed twice
        lists = (row * width, start[t], df[t], doc)
        held = list(_pieces(*lists)) if df[t].sum() <= CELLS else None
        for own, n, i, j in held or _pieces(*lists):
            x = single.take(i, mode="clip")
            x *= np.repeat(w[own].astype(np.float32), n)
            np.add.at(cells.reshape(-1), j, x)
        # of groups' best cells the k-th is no better than the k-th of all
        groups = cells.reshape(hi - lo, width // WIDE, WIDE)
        top = groups.max(1)
        bar = np.partition(top, WIDE - k, axis=1)[:, WIDE - k] - 2 * error[lo:hi] if WIDE >= k else np.zeros(hi - lo)
        bar = np.maximum(bar, least[lo:hi] - error[lo:hi])
        bar = np.maximum(bar, -error[lo:hi])[:, None]
        r, g = np.nonzero(top > bar)
        i, c = np.nonzero(groups[r, :, g] > bar[r])
        r, c = r[i], c * WIDE + g[i]
        s = np.zeros(len(r))
        for a in range(0, len(r), PAIRS):
            b = slice(a, a + PAIRS)
            s[b] = np.einsum("ij,ij->i", part[r[b]], dense[c[b]])
        mark[r * width + c] = np.arange(1, len(r) + 1)
        for own, n, i, j in held or _pieces(*lists) if len(r) else ():
            pair = mark.take(j, mode="clip")
            hit = np.flatnonzero(pair != 0)
            s += np.bincount(pair[hit] - 1, np.repeat(w[own], n)[hit] * value[i[hit]], len(r))
        mark[r * width + c] = 0
        near = np.round(s, 9)
        o = np.lexsort((c, -near, r))
        r, c, s, near = r[o], c[o], s[o], near[o]
        keep = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (near > 0) & (near >= least[lo + r] - NEAR)
        out.append((r[keep] + lo, c[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _pieces(row: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(lists, their lengths, places of their postings, cells) of lists of postings ``n`` long from ``first`` for rows whose cells begin at ``row``, about ``CELLS`` postings at a time."""
    total = np.cumsum(n)
    # a list has a posting for each document at most, so a piece is bounded
    edge = np.searchsorted(total, np.arange(CELLS, total[-1] + CELLS, CELLS), "right") if len(n) else []
    a = 0
    for b in [*edge, len(n)]:
        b = min(len(n), max(int(b), a + 1))
        if a >= b:
            continue
        m = n[a:b]
        i = np.arange(m.sum())
        i += np.repeat(first[a:b] - (np.cumsum(m) - m), m)
        j = doc.take(i, mode="clip")
        j += np.repeat(row[a:b], m)
        yield slice(a, b), m, i, j
        a = b


class Best:
    """Each query's ``k`` best documents of the blocks of documents that went by, ties by the documents' keys."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.keys, self.n = queries, k, [], 0
        self.score, self.at = np.zeros((len(queries.keys), k)), np.full((len(queries.keys), k), -1)

    def take(self, keys: pa.Array, term: np.ndarray, doc: np.ndarray, value: np.ndarray) -> None:
        """Let the postings of a block of documents go by; ``keys`` are in order, each once over all blocks."""
        q, d, s = best(self.queries, len(keys), term, doc, value, self.k, np.round(self.score[:, -1], 9))
        self.keys.append(keys)
        one, q = np.unique(q, return_inverse=True)
        old, place = np.nonzero(self.at[one] >= 0)
        q, d, s = np.concatenate([old, q]), np.concatenate([self.at[one][old, place], d + self.n]), np.concatenate([self.score[one][old, place], s])
        self.n += len(keys)
        rank = ordered(pa.concat_arrays(self.keys))[0]
        o = np.lexsort((rank[d], -np.round(s, 9), q))
        q, d, s = q[o], d[o], s[o]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.score[one], self.at[one] = 0.0, -1
        self.score[one[q[keep]], place[keep]], self.at[one[q[keep]], place[keep]] = s[keep], d[keep]

    def found(self) -> pa.Table:
        q, place = np.nonzero(self.at >= 0)
        return found(self.queries, pa.concat_arrays(self.keys), (q, self.at[q, place], self.score[q, place]))


def found(queries: Queries, docs: pa.Array, got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    q, d, s = got
    return pa.table({"q": queries.keys.take(pa.array(q)), "doc": docs.take(pa.array(d)), "s": pa.array(s)})
