"""Embedding near-dedup against brute force, and the recall of its tables."""

import numpy as np
import pytest

from quire.llm import embeddings
from quire.llm.embeddings import embedding_groups, hash_axes, probe_codes, sketch_reach, sketches, tables_needed

VECTORS = "vec_id long, embedding array<float>, label int"


def components(n, linked):
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        if (low == root).all():
            return root.tolist()
        root = low


def unit(v):
    v = v.astype(np.float32).astype(float)
    return v / np.linalg.norm(v, axis=1)[:, None]


def pairs_at(rng, n, d, cos):
    a, r = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r -= (r * a).sum(1)[:, None] * a
    return a, cos * a + np.sqrt(1 - cos**2) * r / np.linalg.norm(r, axis=1)[:, None]


def case(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 16)), np.repeat(base[:1], 9, 0), base[1:2] + 0.05 * rng.normal(size=(60, 16))])
    return v, [int(i % 2) if i < 60 else 0 for i in range(len(v))]


@pytest.mark.parametrize("own, block", [(512, 512), (4, 8)])
def test_equals_brute_force(spark, monkeypatch, own, block):
    for k, x in (("OWN", own), ("BLOCK", block), ("SKETCH_BLOCK", block)):
        monkeypatch.setattr(embeddings, k, x)
    v, label = case()
    n = len(v)
    rows = [(i, x.tolist(), label[i]) for i, x in enumerate(v)]
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, v[0].tolist(), None), (n + 5, [], 0), (n + 6, [1.0], 0), (n + 7, [float("inf")] * 16, 0)]
    u = unit(v)
    linked = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    got = embedding_groups(spark.createDataFrame(rows, VECTORS)).orderBy("vec_id").collect()
    assert [r.n_links for r in got[:n]] == (linked.sum(1) - 1).tolist()
    assert [r.component_id for r in got[:n]] == components(n, linked)
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got[n:])
    assert embedding_groups(spark.createDataFrame([], VECTORS)).count() == 0


def test_null_ids_repeated_rows_shared_ids_and_clashing_columns(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (3, [0.0, 1.0, 0.1]), (4, [-0.0, 2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 7, 8, 9) for i, v in rows], "vec_id long, embedding array<double>, label string, w long, row long, g int")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in embedding_groups(df).collect())
    assert got == [(-1, 0, None, None), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]


def test_links_of_a_large_label_in_keys_of_several_hashes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "OWN", 2)
    rng = np.random.default_rng(8)
    a, b = pairs_at(rng, 1500, 64, 0.931)
    v = np.concatenate([a, b, np.repeat(a[:1], 1, 0) + 0.02 * rng.normal(size=(300, 64))])
    u = unit(v)
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert len(hash_axes(64, int(np.ceil(np.log2(len(v) / 2))))) == 2
    got = embedding_groups(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], VECTORS)).orderBy("vec_id").collect()
    found = np.array([r.n_links for r in got])
    assert (found <= want).all() and found.sum() >= 0.995 * want.sum()


@pytest.mark.parametrize("dim", [64, 128, 768])
@pytest.mark.parametrize("rows", [10**4, 10**5, 10**7, 10**9])
def test_recall_does_not_fall_as_a_label_grows(dim, rows):
    bits = max(3, int(np.ceil(np.log2(rows / embeddings.OWN))))
    a, b = pairs_at(np.random.default_rng(dim), 400, dim, 0.93)
    n = tables_needed(dim, bits, 0.93)
    x, y = (probe_codes(v, bits, n) for v in (a, b))
    met = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.99
    assert 2**bits * embeddings.OWN >= rows


def test_buckets_of_a_label_stay_small():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(100_000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    bits = int(np.ceil(np.log2(len(v) / embeddings.OWN)))
    own = probe_codes(v, bits, 1)[:, 0, 0]
    assert np.bincount(np.unique(own, return_inverse=True)[1]).max() < 4 * embeddings.OWN


@pytest.mark.parametrize("dim", [2, 16, 64, 768])
def test_sketches_of_linked_vectors_are_near(dim):
    a, b = pairs_at(np.random.default_rng(dim), 2000, dim, 0.93)
    apart = np.bitwise_count(sketches(a) ^ sketches(b)).sum(1)
    assert apart.max() <= sketch_reach(0.93)
