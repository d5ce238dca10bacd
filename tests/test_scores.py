"""Block scoring: many queries in several blocks, ties, postings in several steps."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import inverted, retrieval, scores, scoring
from tests.test_inverted import plain, search


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_best_equals_all_cells(monkeypatch, cells):
    monkeypatch.setattr(scores, "CELLS", cells)
    rng = np.random.default_rng(3)
    weights = {(q, t): float(rng.integers(1, 5)) for q in range(30) for t in rng.integers(0, 40, 6).tolist()}
    rows = pa.table({"q": [f"q{q}" for q, _ in weights], "term": [f"t{t}" for _, t in weights], "w": list(weights.values())})
    queries = scores.Queries.of(rows)
    held = {(int(t), int(d)) for t, d in zip(rng.integers(0, 50, 900) ** 2 // 50, rng.integers(0, 300, 900))}
    term, doc = (np.array(x) for x in zip(*sorted(held)))
    number = queries.find(pa.array([f"t{t}" for t in term]))
    at = number >= 0
    q, d, s = scores.best(queries, 300, number[at], doc[at], np.ones(at.sum()), 4)
    want = []
    for i in range(30):
        total = {}
        for t, x in held:
            if (i, t) in weights:
                total[x] = total.get(x, 0) + weights[i, t]
        want += [(f"q{i}", x, v) for x, v in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:4]]
    assert sorted(zip(queries.keys.take(pa.array(q)).to_pylist(), d.tolist(), s.tolist())) == sorted(want)


def test_many_queries_are_searched_in_blocks_and_shuffle_no_postings(spark, tmp_path, monkeypatch):
    """Queries with more terms than may be broadcast: postings stay where they are."""
    monkeypatch.setattr(inverted, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(inverted, "PUSHED_TERMS", 0)
    monkeypatch.setattr(scores, "BLOCK_TERMS", 60)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{min(int(x), 80)}" for x in rng.zipf(1.4, int(rng.integers(1, 40))))) for i in range(200)]
    queries = [(f"q{i}", " ".join(f"w{min(int(x), 90)}" for x in rng.zipf(1.4, 6))) for i in range(40)]
    got, index = search(spark, docs, queries, str(tmp_path / "ix"), block_docs=50)
    assert got == plain(docs, queries, 3)
    again = index.search(spark.createDataFrame(queries, "q string, text string"), "q", F.split("text", " "), 3)
    again.collect()
    plan = again._jdf.queryExecution().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_near_scores_are_told_apart_in_double_precision(monkeypatch):
    """Cells that single precision holds equal are ordered by their true sums, and ties by document."""
    n = 300
    value = 1 + np.concatenate([np.arange(n) % 7, [0] * n]) * 1e-8
    term, doc = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    want = sorted(range(n), key=lambda d: (-(d % 7), d))[:5]
    for common, cells in ((0.003, 1 << 18), (2.0, 1 << 18), (2.0, 64)):
        monkeypatch.setattr(scores, "COMMON", common)
        monkeypatch.setattr(scores, "CELLS", cells)
        queries = scores.Queries.of(pa.table({"q": ["a", "a", "b"], "term": ["x", "y", "y"], "w": [1.0, 1.0, 2.0]}))
        q, d, s = scores.best(queries, n, term, doc, value, 5)
        assert d[q == 0].tolist() == want and d[q == 1].tolist() == [0, 1, 2, 3, 4]
        assert s[q == 0] == pytest.approx([2 + (x % 7) * 1e-8 for x in want], abs=1e-12)


@pytest.mark.parametrize("blocks", [1, 5])
def test_a_bucket_keeps_no_more_than_the_best_of_its_blocks(blocks):
    """Blocks that go by one after another leave what all documents at once leave, ties by key, and no more rows than that."""
    rng = np.random.default_rng(6)
    rows = pa.table({"q": [f"q{i // 3}" for i in range(60)], "term": [f"t{i}" for i in rng.permutation(60) % 25], "w": rng.integers(1, 3, 60).astype(float)}).group_by(["q", "term"]).aggregate([("w", "sum")]).rename_columns(["q", "term", "w"])
    queries = scores.Queries.of(rows)
    keys = rng.permutation(200)
    held = {(int(t), int(d)) for t, d in zip(rng.integers(0, len(queries.terms), 1500), rng.integers(0, 200, 1500))}
    got = scores.Best(queries, 4)
    for own in np.array_split(keys, blocks):
        own = np.sort(own)
        term, doc = (np.array(x) for x in zip(*sorted((t, int(np.searchsorted(own, d))) for t, d in held if d in own)))
        got.take(pa.array(own), term, doc, np.ones(len(term)))
    found = got.found()
    want = []
    for q in queries.keys.to_pylist():
        weight = {r["term"]: r["w"] for r in rows.to_pylist() if r["q"] == q}
        total = {}
        for t, d in held:
            total[d] = total.get(d, 0) + weight.get(queries.terms[t].as_py(), 0)
        want += [(q, d, s) for d, s in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:4] if s > 0]
    assert sorted(map(tuple, (r.values() for r in found.to_pylist()))) == sorted(want)


def test_numbers_are_looked_for_over_the_edge_of_two_contexts(spark):
    """All contexts together hold numbers that none holds alone; an answer without a number needs none."""
    schema = "answer string, contexts array<struct<title:string,section:string,subsection:string,subtitle:string,text:string,content:string>>"
    contexts = [(None, None, "", None, "alpha beta 5", None), ("mg", None, None, None, "gamma", None)]
    df = spark.createDataFrame([("Alpha beta gamma 5 mg.", contexts), ("Alpha beta gamma.", contexts), ("Alpha beta 5 gamma.", contexts)], schema)
    got = [r[0] for r in df.select(scoring.claim_supports("answer", F.col("contexts"))).collect()]
    assert got[0] == pytest.approx([0.35]) and got[1] == [1.0] and got[2] == pytest.approx([2 / 3])


def test_tokens_of_long_runs(spark):
    """Runs of marks and letters of any length: tokens begin and end with a letter or digit."""
    text = "a-" * 200000 + " -./- ./abc.-/ ab x.. a.b ..12/3-"
    row = spark.createDataFrame([(text,)], "text string").select(tx.tokenize_evidence("text"), tx.tokenize_retrieval("text")).first()
    assert row[0] == ["-".join("a" * 200000), "abc", "a.b", "12/3"] and row[1] == ["abc"]


def test_tokens_are_runs_of_token_characters(spark):
    text = "Été à l'ÉCOLE—naïve×y÷z 日本語abc x1-2/3.4- ..foo.. ’tis 𝒜bcd\n"
    row = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(tx.tokenize_retrieval("text", ["foo"]), tx.tokenize_evidence("text", ["foo"])).collect()
    assert row[0][0] == ["été", "école", "naïve×y÷z", "abc", "tis", "bcd"] and row[0][1] == ["été", "école", "naïve×y÷z", "abc", "x1-2/3.4", "tis", "bcd"]
    assert [list(r) for r in row[1:]] == [[[], []], [[], []]]


def test_searches_of_texts_make_no_row_of_a_pair(spark, monkeypatch):
    """Their only sums by query and document are in arrays: ranks are the one shuffle by query, counts of terms the one by term."""
    monkeypatch.setattr(retrieval, "DOCS", 7)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.4, int(rng.integers(1, 30))))) for i in range(100)] + [(100, None), (101, "")]
    asked = [(f"q{i}", " ".join(f"w{min(int(x), 70)}" for x in rng.zipf(1.4, 6))) for i in range(9)] + [("none", "absent"), ("empty", "")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "q string, text string")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    got = retrieval.bm25_search(q, "q", tokens, d, "id", tokens, 3)
    assert sorted((r["q"], r["doc"], round(r["bm25_score"], 6), r["bm25_rank"]) for r in got.collect()) == plain(docs, asked, 3)
    near = retrieval.overlap_search(q, "q", tokens, d, "id", tokens, 3)
    want = []
    for i, text in asked:
        t = set(text.split())
        hit = [(-round(len(t & set((x or "").split())) / len(t), 9), n) for n, x in docs if t & set((x or "").split())]
        want += [(i, n, -s, r) for r, (s, n) in enumerate(sorted(hit)[:3], 1)]
    assert sorted((r["q"], r["doc"], r["score"], r["rank"]) for r in near.collect()) == sorted(want)
    for found in (got, near):
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_claims_meet_only_words_of_the_answer(spark):
    """Words of the contexts are looked up once for an answer: claims that many contexts support score as each alone."""
    contexts = [{"text": t} for t in ("alpha beta gamma 500 mg", "delta epsilon zeta", "", None)]
    schema = "answer string, contexts array<struct<title:string,section:string,subsection:string,subtitle:string,text:string,content:string>>"
    rows = [("Alpha beta gamma delta. Delta epsilon 700 mg zeta. Unknown words nowhere.", contexts), ("Alpha beta gamma delta.", [{"text": ""}]), ("Alpha beta gamma delta.", [])]
    df = spark.createDataFrame([(a, [(None, None, None, None, c["text"], None) for c in cs]) for a, cs in rows], schema)
    got = [r[0] for r in df.select(scoring.claim_supports("answer", F.col("contexts"))).collect()]
    assert got[0] == pytest.approx([1.0, 0.35 * 3 / 4, 0.0]) and got[1:] == [[0.0], [0.0]]
