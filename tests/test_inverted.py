"""The kept inverted index against BM25 in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import inverted

SCHEMA = "id long, text string, block int, doc int"


def plain(docs, queries, k):
    docs = [(i, (t or "").split()) for i, t in docs if i is not None]
    n, avg = len(docs), sum(len(t) for _, t in docs) / max(1, len(docs))
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    out = []
    for q, text in queries:
        scored = []
        for i, t in docs:
            s = 0.0
            for w in text.split():
                if w in df:
                    idf = 0.25 * mean if raw[w] < 0 else raw[w]
                    tf = t.count(w)
                    s += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
            if any(w in t for w in text.split()):
                scored.append((-round(s, 9), i))
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(sorted(scored)[:k], 1) if s < 0]
    return sorted(out)


def search(spark, docs, queries, path, k=3, **kw):
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    index = inverted.build_inverted(spark.createDataFrame([(*d, 1, 1) for d in docs], SCHEMA), "id", tokens, path, **kw)
    got = index.search(spark.createDataFrame(queries, "q string, text string"), "q", tokens, k).collect()
    return sorted((r["q"], r["doc"], round(r["bm25_score"], 6), r["bm25_rank"]) for r in got), index


@pytest.mark.parametrize("block_docs,pushed", [(4096, 500), (7, 0)])
def test_search_equals_plain_scores(spark, tmp_path, monkeypatch, block_docs, pushed):
    monkeypatch.setattr(inverted, "PUSHED_TERMS", pushed)
    monkeypatch.setattr(inverted, "BUCKET_DOCS", 20)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{min(int(x), 80)}" for x in rng.zipf(1.4, int(rng.integers(1, 40))))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, docs[0][1]), (403, docs[0][1]), (None, "w1 w2"), (404, "w3 " * 5000)]
    queries = [(f"q{i}", " ".join(f"w{min(int(x), 90)}" for x in rng.zipf(1.4, 6))) for i in range(12)] + [("none", "absent"), ("same", "w1 w1 w2"), ("empty", "")]
    got, index = search(spark, docs, queries, str(tmp_path / "ix"), block_docs=block_docs)
    assert got == plain(docs, queries, 3)
    assert index.totals()["n"] == 405 and index.totals()["buckets"] == 21
    # another reader of the same files, after the corpus is gone
    tokens = F.split("text", " ")
    asked = spark.createDataFrame([("x", "w5 w6")], "q string, text string")
    again = inverted.InvertedIndex(spark, str(tmp_path / "ix")).search(asked, "q", tokens, 3)
    assert sorted((r[0], r[1], round(r[2], 6), r[3]) for r in again.collect()) == plain(docs, [("x", "w5 w6")], 3)
    plan = again._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quire_postings")]


def test_empty_corpus_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "ix")
    assert search(spark, [], [("q", "a")], path)[0] == []
    got, _ = search(spark, [(1, "a b"), (2, "b c"), (3, "d")], [("q", "a")], path)
    assert got == plain([(1, "a b"), (2, "b c"), (3, "d")], [("q", "a")], 3)
