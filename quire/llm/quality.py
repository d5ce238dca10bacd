"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and its form: the shapes of words and of word pairs (``Aa``, ``a.``, ``A!``; other scripts
count as letters) and how often words and three-word sequences come again. Words hash to buckets; both groups are weighted by
TF-IDF, with document frequencies of the whole corpus, and brought to length one. The leading directions of a bounded sample of labelled
rows, found by subspace iteration, are the latent space. The sample's vectors are broadcast, every
document's cosines to all of them are computed in blocks, and the nearest ones vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, SPACE, Scratch, fresh, grams, mix, slices, string_buffers, words

#: Buckets of words, of shapes and of repeats; the last term stands for the text itself, so that an empty text has a vector.
WORD_BITS, SHAPE_BITS = 14, 12
REPEATS = 3
TERMS = (1 << WORD_BITS) + (1 << SHAPE_BITS) + REPEATS + 1
_SHAPES, _REPEATS = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Bytes of texts whose terms are found at a time.
_BLOCK = 1 << 18
#: Texts compared with the labelled vectors at a time.
_QUERIES = 256
#: Tasks that sum over the sample: each sends a row of sums for every term that it meets.
_TASKS = 4
#: Sums of the sample are sent as whole numbers of this fraction, which add up alike in any order.
_UNIT = float(1 << 24)
#: Similarities that differ by less than this tie.
TIE = 1e-9

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
_CLASS[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20


def _shapes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each word's shape: classes of its bytes, runs of one class folded."""
    c = _CLASS[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != c[:-1]) | SPACE[c[1:]]
    keep[offsets[:-1][offsets[:-1] < len(c)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return words(c[keep], at[offsets])[3]


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash occurred earlier in its document."""
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(h), bool)
    out[first] = False
    return out


def _counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of texts that lie one after another; ordered by document and term."""
    docs = len(offsets) - 1
    doc, _, _, h = words(raw, offsets, fold=LOWER)
    shape = _shapes(raw, offsets)
    terms = [(h & np.uint64(_SHAPES - 1)).astype(np.int64), _SHAPES + (shape & np.uint64((1 << SHAPE_BITS) - 1)).astype(np.int64)]
    owners = [doc, doc]
    same = doc[1:] == doc[:-1]
    pair = mix(shape[1:] * np.uint64(0x9E3779B97F4A7C15) + shape[:-1])[same]
    owners.append(doc[1:][same])
    terms.append(_SHAPES + (pair & np.uint64((1 << SHAPE_BITS) - 1)).astype(np.int64))
    adjacent = np.flatnonzero(same & (h[1:] == h[:-1]))
    owners.append(doc[adjacent])
    terms.append(np.full(len(adjacent), _REPEATS))
    g = grams(h, 3)
    inside = np.flatnonzero(doc[2:] == doc[: len(g)]) if len(g) else np.zeros(0, np.int64)
    for n, (d, x) in enumerate(((doc[inside], g[inside]), (doc, h)), 1):
        again = d[_again(d, x)]
        owners.append(again)
        terms.append(np.full(len(again), _REPEATS + n))
    owners.append(np.arange(docs))
    terms.append(np.full(docs, TERMS - 1))
    key, n = np.unique(np.concatenate(owners) * TERMS + np.concatenate(terms), return_counts=True)
    return key // TERMS, key % TERMS, n


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """(first document, document, term, count) of blocks of texts: bounds the temporaries."""
    for lo, hi in slices(offsets, _BLOCK):
        doc, term, n = _counts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, doc, term, n


def _weights(doc: np.ndarray, term: np.ndarray, n: np.ndarray, docs: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights; words and form have length one each, before the whole has."""
    w = (1 + np.log(n)) * idf[term]
    for group in (term < _SHAPES, term >= _SHAPES):
        norm = np.sqrt(np.bincount(doc[group], w[group] ** 2, docs))
        w[group] /= norm[doc[group]]
    return w / np.sqrt(np.bincount(doc, w**2, docs))[doc]


def _project(doc: np.ndarray, term: np.ndarray, w: np.ndarray, docs: int, basis: np.ndarray) -> np.ndarray:
    """(documents, columns of the basis): the sum of each document's weighted rows of the basis."""
    out = np.zeros((docs, basis.shape[1]))
    if len(doc):
        most = max(1, (1 << 21) // basis.shape[1])
        for lo in range(0, len(doc), most):
            d = doc[lo : lo + most]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            out[d[first]] += np.add.reduceat(basis[term[lo : lo + most]] * w[lo : lo + most, None], first, 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(norm > 1e-12, x / np.maximum(norm, 1e-300), 0.0)


@dataclass(frozen=True)
class QualityModel:
    """Fitted model: inverse document frequencies, latent directions, and the labelled vectors with their labels."""

    idf: np.ndarray  # by term
    basis: np.ndarray  # (terms, rank)
    vectors: np.ndarray  # (labelled, rank), of length one or zero
    labels: np.ndarray  # 0 to 1
    neighbours: int

    def vote(self, v: np.ndarray) -> np.ndarray:
        """Score of each latent vector. All labelled vectors as near as the last neighbour vote; without a similar
        one the share of label 1 in the sample is the score."""
        prior = self.labels.mean() if len(self.labels) else 0.5
        out = np.full(len(v), prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(v), _QUERIES):
            near = _unit(v[lo : lo + _QUERIES]) @ self.vectors.T
            least = np.partition(near, len(self.labels) - k, 1)[:, len(self.labels) - k]
            row, col = np.nonzero(near >= least[:, None] - TIE)
            weight = np.maximum(near[row, col], 0.0)
            weight[weight <= TIE] = 0.0
            of = np.bincount(row, weight, len(near))
            yes = np.bincount(row, weight * self.labels[col], len(near))
            some = of > 0
            out[lo : lo + len(near)][some] = np.clip(yes[some] / of[some], 0.0, 1.0)
        return out


def _term_sums(docs: DataFrame, text: Column) -> DataFrame:
    """(term, documents with it), summed in each task before the shuffle."""

    def run(batches):
        df = np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, _, _, term, _ in _pieces(*string_buffers(batch.column(0))):
                df += np.bincount(term, minlength=TERMS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["k", "n"])

    return docs.select(text.alias("t")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    labelled: int = 16_384,
    rank: int = 64,
    neighbours: int = 15,
    iterations: int = 3,
) -> QualityModel:
    """Fit on the rows of ``docs`` that ``labels`` marks.

    Documented bound: at most ``labelled`` examples are drawn, by a hash of the id; document frequencies are
    those of all ``docs``. Labels that are neither 0 nor 1 and null ids are ignored; several labels of one id are averaged; of rows with
    one id, each different text is an example. Without examples the model scores every text 0.5. What the driver holds is of the size of the
    terms and the sample.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    named = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("k"))
    draw = F.xxhash64(F.col("i").cast("string"), F.lit(13))
    # no text is shuffled before the sample is drawn
    chosen = scratch.table(named.select("i", "k").join(marked, "i").distinct().orderBy(draw, "i", "k").limit(labelled))
    sample = named.join(F.broadcast(chosen), ["i", "k"]).dropDuplicates(["i", "k"])
    sample = scratch.table(sample.repartition(2 * _TASKS, "i", "k").sortWithinPartitions("i", "k")).coalesce(_TASKS)
    size = sample.count()
    sums = _term_sums(docs, F.col(text_col)).toArrow()
    df = np.zeros(TERMS)
    df[sums["k"].to_numpy()] = sums["n"].to_numpy()
    # the text's own term is in every document
    idf = np.log((1.0 + df.max()) / (1.0 + df)) + 1
    if not size:
        return QualityModel(idf, np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), neighbours)

    def spread(shared):
        """Each term's sum over the sample of weight times projection: one step of the subspace iteration."""

        def run(batches):
            idf, basis = shared.value
            out = np.zeros(basis.shape)
            for batch in batches:
                for lo, hi, doc, term, n in _pieces(*string_buffers(batch.column(0))):
                    w = _weights(doc, term, n, hi - lo, idf)
                    y = _project(doc, term, w, hi - lo, basis)
                    order = np.argsort(term, kind="stable")
                    most = max(1, (1 << 21) // basis.shape[1])
                    for at in range(0, len(order), most):
                        o = order[at : at + most]
                        t = term[o]
                        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                        out[t[first]] += np.add.reduceat(y[doc[o]] * w[o, None], first, 0)
            at = np.flatnonzero(np.abs(out).sum(1))
            for lo in range(0, len(at), 1024):
                part = out[at[lo : lo + 1024]]
                cells = pa.array(np.round(part.ravel() * _UNIT).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 1024]), pa.FixedSizeListArray.from_arrays(cells, part.shape[1]).cast(pa.list_(pa.int64()))], names=["k", "z"])

        return run

    columns = min(rank + 8, size)
    basis = np.linalg.qr(np.random.default_rng(20260301).normal(size=(TERMS, columns)))[0]
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((idf, basis))
        parts = sample.select("t").mapInArrow(spread(shared), "k long, z array<long>")
        sums = parts.groupBy("k").agg(*[F.sum(F.col("z")[c]).alias(f"z{c}") for c in range(columns)]).toArrow()
        z = np.zeros(basis.shape)
        for c in range(columns):
            z[sums["k"].to_numpy(), c] = sums[f"z{c}"].to_numpy() / _UNIT
        shared.unpersist()
        value, turn = np.linalg.eigh(basis.T @ z)
        previous, basis = basis, np.linalg.qr(z)[0]
    top = np.argsort(-value)[: min(rank, columns)]
    basis = previous @ turn[:, top]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(len(top))] < 0, -1.0, 1.0)
    at = sample.columns.index("t")
    shared = spark.sparkContext.broadcast(QualityModel(idf, basis, np.zeros((0, len(top))), np.zeros(0), neighbours))

    def place(batches):
        m = shared.value
        for batch in batches:
            raw, off = string_buffers(batch.column(at))
            v = [_project(d, t, _weights(d, t, n, hi - lo, m.idf), hi - lo, m.basis) for lo, hi, d, t, n in _pieces(raw, off)]
            v = np.concatenate(v) if v else np.zeros((0, m.basis.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(v), pa.list_(pa.float64()))], names=["y", "v"])

    rows = sample.mapInArrow(place, "y double, v array<double>").toArrow().combine_chunks()
    v = np.asarray(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(top))
    y = rows["y"].to_numpy()
    order = np.lexsort((y, *v.T[::-1]))
    return QualityModel(idf, basis, _unit(v[order]), y[order], neighbours)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) to every row, from its whole text alone.

    A null text counts as the empty one, which has a vector and neighbours like any other. Equal texts get equal
    scores; repeated rows are kept; columns of the two names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*names)
    copy = fresh([*docs.columns, *names], "__text")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, off = string_buffers(batch.column(width))
            score = np.zeros(len(batch))
            for lo, hi, doc, term, n in _pieces(raw, off):
                v = _project(doc, term, _weights(doc, term, n, hi - lo, m.idf), hi - lo, m.basis)
                score[lo:hi] = np.round(m.vote(v), 9)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], *names]
            )

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {k}" for n, k in zip(names, ("double", "int")))])
    return docs.withColumn(copy, F.col(text_col)).mapInArrow(run, out)
