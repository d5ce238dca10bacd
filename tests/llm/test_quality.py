"""The quality classifier: votes against all pairs, terms against plain counting, held-out accuracy, degenerate tables."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm.quality import _REPEATS, TERMS, QualityModel, _counts, fit_quality, score_quality

SF = "/root/testdata/sf0.01"


def buffers(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_terms_equal_plain_counts():
    texts = ["One two, two two THREE!! x1 one two two", "", "a\tb  a\nb a b c", "naïve Ñandú 12:30", " ", "b a b a"]
    doc, term, n = _counts(*buffers(texts))
    for d, text in enumerate(texts):
        words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in text.encode().split()]
        shapes = [re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Z]", "A", re.sub(r"[^\x00-\x7f]|[a-z]", "a", re.sub(r"\d", "0", w)))) for w in text.split()]
        of = dict(zip(term[doc == d], n[doc == d]))
        assert of.pop(TERMS - 1) == 1
        assert of.pop(_REPEATS, 0) == sum(a == b for a, b in zip(words, words[1:]))
        assert of.pop(_REPEATS + 1, 0) == max(0, len(words) - 2) - len(set(zip(words, words[1:], words[2:])))
        assert of.pop(_REPEATS + 2, 0) == len(words) - len(set(words))
        plain = Counter(words) + Counter(shapes) + Counter(zip(shapes, shapes[1:]))
        assert sorted(of.values()) == sorted(plain.values())


def test_votes_equal_all_pairs():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(700, 12))
    v[:40] = v[40:80] * 2  # ties
    known = v / np.sqrt((v * v).sum(1, keepdims=True))
    labels = (rng.random(700) < 0.7).astype(float)
    asked = np.concatenate([rng.normal(size=(600, 12)), v[:50], np.zeros((1, 12))])
    got = QualityModel(np.ones(1), np.ones((1, 12)), known, labels, 9).vote(asked)
    for x, s in zip(asked, got):
        near = [float(np.dot(x, k)) / (float(np.sqrt(x @ x)) or 1.0) for k in known]
        least = sorted(near)[-9]
        votes = [(c, y) for c, y in zip(near, labels) if c >= least - 1e-9 and c > 1e-9]
        assert abs(s - (sum(c * y for c, y in votes) / sum(c for c, _ in votes) if votes else labels.mean())) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_quality(docs, labels.where(~held))
    assert model.basis.shape[1] == 64 and np.allclose(model.basis.T @ model.basis, np.eye(64), atol=1e-6)
    rows = score_quality(docs, model).join(labels, "doc_id").where(held).select("quality", "predicted").collect()
    assert len(rows) > 80 and sum(r[0] == r[1] for r in rows) >= 0.97 * len(rows)
    bounded = fit_quality(docs, labels, labelled=50, rank=8)
    assert len(bounded.labels) == 50 and bounded.basis.shape[1] == 8


def test_degenerate_tables(spark):
    schema = "doc_id long, text string, score string, quality int, t int, i int, k int"
    rows = [(i, f"Some words of text {i} here.", "x", 1, 1, 1, 1) for i in range(30)]
    rows += [(100 + i, f"SOME!! WORDS!! {i}!! HERE!!", "x", 0, 1, 1, 1) for i in range(30)]
    rows += [(200, None, "x", 1, 1, 1, 1), (201, "", "x", 1, 1, 1, 1), (None, "Some words", "x", 1, 1, 1, 1), (202, "Some words. " * 20_000, "x", 1, 1, 1, 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, schema)
    marks = [(r[0], r[3], None) for r in rows] + [(0, 5, None), (1, None, None), (2, 0, None), (None, 1, None), (999, 1, None)]
    model = fit_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert len(model.labels) == 63
    out = score_quality(docs, model)
    assert sorted(out.columns) == sorted([*docs.columns, "predicted"]) and out.count() == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in by.values())
    assert by[200, None]["score"] == by[201, ""]["score"]
    assert all(by[r[0], r[1]]["predicted"] == r[3] for r in rows[:60])
    none = fit_quality(docs.limit(0), docs.limit(0))
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), model).collect() == []
