"""Language ID with a bit-sliced Bloom filter of byte n-grams.

One filter row holds a bit for each language; ANDing the rows that an n-gram hashes to
gives all languages that contain it at once. Per-language popcounts over a text, corrected
for each language's false-positive rate, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, fresh, mix, slices, string_buffers

#: Letters in, everything else a space: ASCII letters fold to lower case, UTF-8 bytes of
#: other scripts are kept.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = LOWER[65:91]
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


#: Bytes of texts taken at a time: every byte needs some 80 of temporaries.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class LanguageFilters:
    """Fitted model: ``rows[i]`` holds the bits of the languages that set filter row i."""

    languages: tuple[str, ...]
    rows: np.ndarray  # (m, words) uint64
    false_positive: np.ndarray  # by language
    prior: np.ndarray  # by language
    n: int
    probes: int


def _ngrams(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram with a letter; a text is padded with a space at both ends."""
    sizes = np.diff(offsets)
    at = offsets[:-1] + 2 * np.arange(len(sizes)) + 1
    b = np.full(len(raw) + 2 * len(sizes), 32, np.uint8)
    shift = np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    b[np.arange(len(raw)) + shift] = _FOLD[raw]
    # upper case of the Latin-1 letters: second byte 80..9E after C3
    up = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
    b[1:][up] += 32
    count = len(b) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, letter = np.zeros(count, np.uint64), np.zeros(count, bool)
    for i in range(n):
        part = b[i : i + count]
        h = (h << np.uint64(8)) | part
        letter |= part != 32
    doc = np.searchsorted(at - 1, np.arange(count), "right") - 1
    ok = letter & (np.arange(count) + n <= (at + sizes + 1)[doc])
    return doc[ok], mix(h[ok])


def fit_languages(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    n: int = 4,
    docs_per_language: int = 4000,
    grams_per_language: int = 60_000,
    typical: float = 0.25,
    probes: int = 3,
) -> LanguageFilters:
    """Fit filters on labelled rows.

    Documented bounds: about ``docs_per_language`` rows of each language are drawn, by a hash
    of the id, and at most ``grams_per_language`` n-grams are kept for each, the most frequent
    ones (ties go together). An n-gram is in a language's filter if its rate there is at
    least ``typical`` times its highest rate in any language. Null texts or languages are no
    training rows. With no training row the model has no language and predicts ``und``.
    """
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    held = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    langs = tuple(sorted(held))
    if not langs:
        return LanguageFilters((), np.zeros((1, 1), np.uint64), np.zeros(0), np.zeros(0), n, probes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_language / held[k]))])
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    code = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    drawn = train.where(chance < share[F.col(lang_col)]).select(code[F.col(lang_col)].alias("l"), F.col(text_col).alias("t"))

    def count(batches):
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            lang = batch.column(0).to_numpy()
            for lo, hi in slices(off, _BLOCK):
                doc, h = _ngrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                of = lang[lo:hi][doc]
                for k in np.unique(of):
                    g, c = np.unique(h[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))],
                        names=["l", "g", "c"],
                    )

    counts = drawn.mapInArrow(count, "l int, g long, c long")
    by = counts.groupBy("g").agg(*[F.coalesce(F.sum(F.when(F.col("l") == i, F.col("c"))), F.lit(0)).alias(f"c{i}") for i in range(len(langs))])
    by = by.persist()
    total = by.agg(*[F.sum(f"c{i}") for i in range(len(langs))]).first() or []
    total = np.array([max(1, x or 0) for x in total], float)
    steps = by.select(F.posexplode(F.array(*[f"c{i}" for i in range(len(langs))])).alias("l", "c")).where("c > 0").groupBy("l", "c").count().collect()
    floor = []
    for i in range(len(langs)):
        kept, least = 0, 1 << 60
        for c, m in sorted(((r["c"], r["count"]) for r in steps if r["l"] == i), reverse=True):
            if kept + m > grams_per_language:
                break
            kept, least = kept + m, c
        floor.append(least)
    rate = [F.col(f"c{i}") / F.lit(total[i]) for i in range(len(langs))]
    best = F.greatest(*rate) if len(langs) > 1 else rate[0]
    member = F.array_compact(
        F.array(*[F.when((F.col(f"c{i}") >= floor[i]) & (rate[i] >= typical * best), F.lit(i)) for i in range(len(langs))])
    )
    found = by.select("g", member.alias("m")).where(F.size("m") > 0).collect()
    by.unpersist()
    rows = np.zeros((1 << max(10, (16 * max(1, min(len(found), grams_per_language)) - 1).bit_length()), -(-len(langs) // 64)), np.uint64)
    g = np.array([r["g"] for r in found], np.int64).view(np.uint64)
    m = np.zeros((len(found), rows.shape[1]), np.uint64)
    for i, r in enumerate(found):
        for k in r["m"]:
            m[i, k // 64] |= np.uint64(1 << (k % 64))
    for at in _rows(g, len(rows), probes):
        for w in range(rows.shape[1]):
            np.bitwise_or.at(rows[:, w], at, m[:, w])
    fill = np.array([((rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    prior = np.array([held[k] for k in langs], float)
    return LanguageFilters(langs, rows, fill**probes, prior / prior.sum(), n, probes)


def _rows(h: np.ndarray, m: int, probes: int):
    """The filter rows of each hash: double hashing on its halves."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(probes):
        yield ((a + np.uint64(i) * b) & np.uint64(m - 1)).astype(np.int64)


def language_scores(model: LanguageFilters, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corrected popcounts by document and language, n-grams by document)."""
    docs, langs = len(offsets) - 1, len(model.languages)
    doc, h = _ngrams(raw, offsets, model.n)
    mask = None
    for at in _rows(h, len(model.rows), model.probes):
        mask = model.rows[at] if mask is None else mask & model.rows[at]
    n = np.bincount(doc, minlength=docs)
    hits = np.zeros((docs, langs))
    for k in range(langs):
        bit = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        hits[:, k] = np.bincount(doc[bit.astype(bool)], minlength=docs)
    fp = model.false_positive
    return np.maximum(0.0, (hits - n[:, None] * fp) / (1 - fp)), n


def identify_language(docs: DataFrame, model: LanguageFilters, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """Add lang_pred, score and coverage (or ``names``) to every row, read from the whole text alone.

    score is the best language's share of all corrected popcounts, coverage their share of the
    text's n-grams. ``und`` with score 0 for a null text or one with no letter. A text whose
    n-grams are unknown to every filter gets the language most frequent in training, with its
    share there as the score. Of languages with equal counts the first in alphabetical order wins. Repeated rows
    are kept; columns of the three names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*names)
    letter_col = fresh([*docs.columns, *names], "__letter")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, off = string_buffers(batch.column(at))
            letter = batch.column(width).to_numpy(zero_copy_only=False).astype(bool)
            best, share, cover = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
            for lo, hi in slices(off, _BLOCK):
                if not m.languages:
                    break
                est, n = language_scores(m, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                none = est.sum(1) <= 0
                est[none] = m.prior
                best[lo:hi] = est.argmax(1)
                share[lo:hi] = est.max(1) / est.sum(1)
                cover[lo:hi] = np.where(none, 0.0, np.minimum(1.0, est.max(1) / np.maximum(1, n)))
            ok = letter & bool(m.languages)
            pred = [m.languages[i] if x else "und" for i, x in zip(best, ok)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(np.where(ok, cover, 0.0))],
                names=[*batch.schema.names[:-1], *names],
            )

    schema = docs.schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "double")))])
    return docs.withColumn(letter_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, out)
