"""Substring dedup with suffix automata.

The reference of a corpus against itself is the corpus, so its shards are formed by content
and each text visits only the automata it can match. Every window of ``window`` words is
represented by its least n-gram hash (winnowing), so equal windows share an anchor. The first
occurrence of an anchor in the corpus names its home document; every document sends the
stretches round its repeated anchors to the shards of their homes. A shard streams its
stretches, in corpus order, through one suffix automaton: after each word the automaton
gives the matching statistic, the longest suffix that has occurred before. Where it reaches
the window, the window repeats an earlier one. Shards above ``SHARD_WORDS`` (a passage shared
by very many documents) would serialise one task; they are cut into pieces, the words of all
windows with one anchor. A piece that has occurred before goes whole; windows are compared one
by one within the first pieces of each content only. Both are keyed by 128-bit hashes and
compared with the least occurrence of the key, combined before the shuffle.
Both ways are exact but for hash collisions of 64-bit words and 128-bit windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, grams, mix, powers, slices, string_buffers, words

ANCHOR, SHARD_WORDS = 6, 100_000
_LAST = (1 << 63) - 1
_OTHER = np.uint64(0x5851F42D4C957F2D)


class SuffixAutomaton:
    """Online suffix automaton of many sequences; reports the longest earlier match at each word."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def extend(self, sequence) -> list[int]:
        """Add a sequence; for each place, the longest suffix up to it that has occurred before."""
        nxt, link, size = self.next, self.link, self.size
        out, last = [], 0
        for i, c in enumerate(sequence):
            p = last
            q = nxt[p].get(c)
            if q is not None:
                if size[q] != size[p] + 1:
                    q = self._split(p, q, c)
                last = q
                out.append(i + 1)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[p] + 1)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, c)
            last = cur
            out.append(size[link[cur]])
        return out

    def _split(self, p: int, q: int, c) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone


def _winnow(g: np.ndarray, n: int, span: int, whole: np.ndarray | None = None):
    """(first window, last window + 1, n-gram place, places of ties): runs of windows and a least n-gram that all of them hold.

    Where a least n-gram repeats within windows, as in periodic text, one place serves all
    windows that hold it, so such text has no more anchors than other text.
    """
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, span):
        better = g[j : j + n] <= least
        least[better] = g[j : j + n][better]
        at[better] = np.flatnonzero(better) + j
    ok = np.arange(n) if whole is None else np.flatnonzero(whole)
    if not len(ok):
        return ok, ok, ok, ok
    cut = np.flatnonzero((np.diff(ok) > 1) | (np.diff(least[ok]) != 0)) + 1
    lo, hi = ok[np.concatenate([[0], cut])], ok[np.concatenate([cut, [len(ok)]]) - 1] + 1
    q = at[lo]
    tied = q != at[hi - 1]
    more = []
    for a, b in zip(lo[tied].tolist(), hi[tied].tolist()):
        while a < b:
            p = int(at[a])
            more.append((a, min(b, p + 1), p))
            a = p + 1
    if not more:
        return lo, hi, q, q[:0]
    more = np.array(more).T
    lo, hi, q = (np.concatenate([v[~tied], w]) for v, w in zip((lo, hi, q), more))
    return lo, hi, q, more[2]


def _anchors(batches, window: int):
    """(a, d, xp): an anchor hash, the document and (text check << 32) + word place."""
    span = window - ANCHOR + 1
    for batch in batches:
        d, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw, off = string_buffers(batch.column(2))
        for lo, hi in slices(off):
            o = off[lo : hi + 1] - off[lo]
            doc, _, _, h = words(raw[off[lo] : off[hi]], o)
            g = grams(h, ANCHOR)
            n = len(h) - window + 1
            if n <= 0:
                continue
            _, _, at, tied = _winnow(g, n, span, doc[:n] == doc[window - 1 :])
            # windows that share a tied place may equal each other: it counts as met twice
            at = np.concatenate([np.unique(at), np.unique(tied)])
            if len(at):
                row = doc[at]
                first = np.searchsorted(doc, np.arange(hi - lo))
                xp = (x[lo + row] << np.int64(32)) | (at - first[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at].view(np.int64)), pa.array(d[lo + row]), pa.array(xp)], names=["a", "d", "xp"]
                )


def _stretches(batches, window: int):
    """(home_d, home_x, d, x, start, h): words round a document's repeated anchors, by home."""
    before, after = window - ANCHOR, window
    for batch in batches:
        raw, off = string_buffers(batch.column(2))
        d, x, places = batch.column(0), batch.column(1), batch.column(3).to_pylist()
        for lo, hi in slices(off):
            doc, _, _, h = words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            hd, hx, od, ox, os, ow = [], [], [], [], [], []
            for r in range(lo, hi):
                base, n = int(bounds[r - lo]), int(bounds[r - lo + 1] - bounds[r - lo])
                by: dict[tuple, list] = {}
                for p in places[r]:
                    by.setdefault((p["hd"], p["hx"]), []).append(p["p"])
                for home, at in by.items():
                    at.sort()
                    s, e = 0, -(1 << 40)
                    for p in [*at, None]:
                        if p is not None and p - before <= e:
                            e = min(n, p + after)
                            continue
                        if e - s >= window:
                            hd.append(home[0])
                            hx.append(home[1])
                            od.append(d[r].as_py())
                            ox.append(x[r].as_py())
                            os.append(s)
                            ow.append(h[base + s : base + e].view(np.int64))
                        if p is not None:
                            s, e = max(0, p - before), min(n, p + after)
            if od:
                size = np.fromiter(map(len, ow), np.int32, len(ow))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ow)))
                cols = [pa.array(v, pa.int64()) for v in (hd, hx, od, ox, os)]
                yield pa.RecordBatch.from_arrays([*cols, lists], names=["hd", "hx", "d", "x", "s", "h"])


def _runs(ends: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) spans of the windows that end at the given places."""
    cut = np.flatnonzero(np.diff(ends) > window)
    lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ends) - 1]])
    return [(int(ends[a]) - window + 1, int(ends[b]) + 1) for a, b in zip(lo, hi)]


def _stream(batches, window: int):
    """Matching statistics of each home's stretches in corpus order; rows come sorted by home."""
    home, automaton = None, None
    for b in batches:
        hd, hx, d, x, s = (b.column(i).to_numpy() for i in range(5))
        out = []
        for r in range(len(b)):
            if (hd[r], hx[r]) != home:
                home, automaton = (hd[r], hx[r]), SuffixAutomaton()
            longest = np.array(automaton.extend(b.column(5)[r].values.to_pylist()))
            ends = np.flatnonzero(longest >= window)
            if len(ends):
                out += [(int(d[r]), int(x[r]), int(s[r]) + i, int(s[r]) + j) for i, j in _runs(ends, window)]
        cols = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "x", "s", "e"])


def _pieces(batches, window: int):
    """(k1, k2, d, x, s, e, h): 128-bit hash, place and words of the windows of each anchor."""
    span = window - ANCHOR + 1
    for b in batches:
        d, x, s = (b.column(i).to_numpy() for i in range(3))
        out, lists = [], []
        for r in range(len(b)):
            h = b.column(3)[r].values.to_numpy().view(np.uint64)
            n, g = len(h) - window + 1, grams(h, ANCHOR)
            lo, hi, _, _ = _winnow(g, n, span)
            hi = hi + window - 1
            pw, inv = powers(1 << max(12, len(h).bit_length()))
            keys = []
            for v in (h, mix(h ^ _OTHER)):
                acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * pw[: len(h)])])
                keys.append(mix((acc[hi] - acc[lo]) * inv[lo]).view(np.int64).tolist())
            for k1, k2, i, j in zip(*keys, lo.tolist(), hi.tolist()):
                out.append((k1, k2, int(d[r]), int(x[r]), int(s[r]) + i, int(s[r]) + j))
                lists.append(h[i:j].view(np.int64))
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols), pa.array(lists, pa.list_(pa.int64()))], names=["k1", "k2", "d", "x", "s", "e", "h"]
        )


def _windows(batches, window: int):
    """(w1, w2, d, x, s): 128-bit hash and place of every window of the stretches."""
    for b in batches:
        vals, off = b.column(3).flatten().to_numpy().view(np.uint64), np.asarray(b.column(3).offsets)
        off = off - off[0]
        n = len(vals) - window + 1
        if n <= 0:
            continue
        row = np.searchsorted(off, np.arange(n), "right") - 1
        ok = np.flatnonzero(np.arange(n) + window <= off[row + 1])
        r = row[ok]
        one, two = grams(vals, window)[ok], grams(mix(vals ^ _OTHER), window)[ok]
        d, x, s = (b.column(i).to_numpy() for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(d[r]), pa.array(x[r]), pa.array(s[r] + ok - off[r])],
            names=["w1", "w2", "d", "x", "s"],
        )


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(d, x, everything, spans): what to remove from each document ``docs(d, x, t)`` that repeats earlier text."""
    slim = docs.select("d", "x", F.md5("t").alias("m"))
    group = slim.groupBy("m").agg(F.min("d").alias("first_d"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = scratch.table(slim.join(group, "m").where("d > first_d").select("d", "x").distinct())
    anchors = scratch.table(docs.select("d", "x", "t").mapInArrow(lambda it: _anchors(it, window), "a long, d long, xp long"))
    # what is joined back is written first: a join may split an anchor of very many places only if no side was dealt out before
    twice = scratch.table(anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    met = anchors.join(twice, "a").select("a", "d", F.shiftrightunsigned("xp", 32).alias("x"), F.col("xp").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p"))
    met = scratch.table(met.join(copies, ["d", "x"], "left_anti"))
    scratch.drop(anchors, twice)
    home = met.groupBy("a").agg(F.min(F.struct("d", "x", "p")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    home = scratch.table(home.select("a", "h"))
    by_doc = (
        met.join(home, "a")
        .groupBy("d", "x")
        .agg(F.collect_list(F.struct("p", F.col("h.d").alias("hd"), F.col("h.x").alias("hx"))).alias("places"))
    )
    one_each = by_doc.join(docs, ["d", "x"]).select("d", "x", "t", "places")
    kind = "hd long, hx long, d long, x long, s long, h array<long>"
    parts = scratch.table(one_each.mapInArrow(lambda it: _stretches(it, window), kind).distinct())
    load = parts.groupBy("hd", "hx").agg(F.sum(F.size("h")).alias("load"), F.count(F.lit(1)).alias("parts"))
    sized = parts.join(load, ["hd", "hx"])
    light = (
        sized.where(F.col("load") <= shard_words)
        .select("hd", "hx", "d", "x", "s", "h")
        .repartition("hd", "hx")
        .sortWithinPartitions("hd", "hx", "d", "x", "s")
        .mapInArrow(lambda it: _stream(it, window), "d long, x long, s long, e long")
    )
    pieces = scratch.table(
        sized.where(F.col("load") > shard_words)
        .select("d", "x", "s", "h")
        .mapInArrow(lambda it: _pieces(it, window), "k1 long, k2 long, d long, x long, s long, e long, h array<long>")
    )
    first = pieces.groupBy("k1", "k2").agg(F.min(F.struct("d", "x", "s", "e", "h")).alias("f"))
    first = scratch.table(first.select("k1", "k2", "f.*"))
    place = F.struct("d", "x", "s")
    known = first.select("k1", "k2", place.alias("least"))
    again = pieces.select("k1", "k2", "d", "x", "s", "e").join(known, ["k1", "k2"]).where(place > F.col("least")).select("d", "x", "s", "e")
    single = scratch.table(
        first.select("d", "x", "s", "h").mapInArrow(lambda it: _windows(it, window), "w1 long, w2 long, d long, x long, s long")
    )
    least = single.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = single.join(least, ["w1", "w2"]).where(place > F.col("least")).select("d", "x", "s", (F.col("s") + window).alias("e"))
    spans = light.unionByName(again).unionByName(later)
    per_doc = spans.groupBy("d", "x").agg(F.collect_list(F.struct("s", "e")).alias("spans")).withColumn("everything", F.lit(False))
    out = per_doc.unionByName(copies.select("d", "x", F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("spans"), F.lit(True).alias("everything")))
    return scratch.table(out)


def _keep(text: bytes, everything: bool, spans, window: int) -> tuple[str, int, int]:
    w = text.split()
    n = len(w)
    if n < window or not (everything or spans):
        return b" ".join(w).decode(), n, 0
    if everything:
        return "", n, n
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["s"]] += 1
        edge[s["e"]] -= 1
    stay = np.flatnonzero(np.cumsum(edge)[:n] == 0)
    return b" ".join([w[i] for i in stay.tolist()]).decode(), n, n - len(stay)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(id_col, kept_text, n_words, n_removed) of every row.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document
    of smaller id, or earlier in the same one. Words are runs of bytes other than ASCII white
    space; kept words are joined by one space. Null and empty texts have no words. A null id
    comes last; rows that share an id and a text are one document and get the same result;
    different texts of one id are documents in order of their CRC32. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    t = F.col(text_col)
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d"),
        F.coalesce(F.crc32(t), F.lit(0)).alias("x"),
        F.coalesce(t, F.lit("")).alias("t"),
    )
    gone = repeated_spans(keyed.select("d", "x", "t"), scratch, window, shard_words)

    def run(batches):
        for b in batches:
            text, every, spans = (b.column(i).to_pylist() for i in (1, 2, 3))
            got = [_keep(x.encode(), bool(e), s, window) for x, e, s in zip(text, every, spans)]
            kept, n, m = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                names=[id_col, "kept_text", "n_words", "n_removed"],
            )

    joined = keyed.join(gone, ["d", "x"], "left").select("id", "t", "everything", "spans")
    return joined.mapInArrow(run, f"`{id_col}` long, kept_text string, n_words long, n_removed long")
