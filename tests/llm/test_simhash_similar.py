"""Near-dedup at a similarity of word shingles against brute force and on degenerate tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import simhash_similar as S

DOCS = "doc_id long, text string, id long, key long, n long, a long, component_id long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in enumerate(texts)], DOCS)


def corpus(seed=3):
    """Ten base texts, each with copies that have some words replaced, and texts of their own."""
    rng = np.random.default_rng(seed)
    out = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 150)) for _ in range(40)]
    for b in range(10):
        for edits in (0, 1, 1, 1, 2, 2, 2, 30):
            w = out[b].split()
            for p in rng.choice(150, edits, replace=False):
                w[p] = f"e{rng.integers(1 << 30)}"
            out.append(" ".join(w))
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def roots(n, linked):
    at = list(range(n))
    for i in range(n):
        for j in range(i):
            if at[i] != at[j] and linked(i, j):
                lo, hi = sorted((at[i], at[j]))
                at = [lo if x == hi else x for x in at]
    return at


@pytest.mark.parametrize("blocks", [(128, 512), (2, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "MINOR", blocks[0])
    monkeypatch.setattr(S, "MAJOR", blocks[1])
    texts = corpus()
    got = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, texts)).collect()}
    fp = {r.doc: r for r in S.wide_fingerprints(table(spark, texts), "doc_id", "text", 5).collect()}
    bits = {i: np.array(r.fp, np.int64).view(np.uint64) for i, r in fp.items()}
    near = lambda i, j: np.bitwise_count(bits[i] ^ bits[j]).sum() <= S.farthest(fp[i].n, fp[j].n, 0.8)
    by_distance = roots(len(texts), near)
    assert [got[i] for i in range(len(texts))] == by_distance
    for i in range(len(texts)):
        for j in range(i):
            x = jaccard(texts[i], texts[j])
            assert x < 0.87 or got[i] == got[j]
            assert x > 0.7 or not near(i, j)


def test_blocks_join_components_that_do_not_meet_the_hub(spark):
    texts = corpus()
    nodes = S.wide_fingerprints(table(spark, texts), "doc_id", "text", 5).withColumn("id", S.F.col("doc")).where("id < 10 OR id >= 40")
    met = nodes.select(S.F.lit(7).cast("long").alias("key"), "id")
    comp = nodes.select(S.F.col("id").alias("node"), S.F.col("id").alias("root"))
    links = S._rest(met, nodes, comp, 0.8, S.Scratch(spark)).collect()
    up = roots(len(texts), lambda i, j: any({i, j} == {r.a, r.b} for r in links))
    assert len({up[40 + 8 * b + k] for b in range(10) for k in range(3)} | {up[b] for b in range(10)}) == 10


def test_bits_are_majorities_of_the_shingle_set():
    h = np.random.default_rng(0).integers(0, 1 << 63, 700).astype(np.uint64)
    bit, far = S.majorities(h)
    assert len(bit) == S.SIZE and len(far) == S.KEYED
    x = S.mix(h[:, None] ^ S._SALTS[None, :])
    for p in (0, 1, 63, 64, 700, S.SIZE - 1):
        ones = sum(int(v) >> (p % 64) & 1 for v in x[:, p // 64])
        assert bit[p] == (2 * ones > 700) and (p >= S.KEYED or far[p] == abs(2 * ones - 701))


def test_keys_meet_when_each_side_turns_one_near_bit():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(1 << 62), 1 << 62, (1, S.WORDS64))
    near = np.tile(np.arange(S.NEAR, dtype=np.uint8), (1, S.SEGMENTS))
    other = fp.copy()
    other[0, 0] ^= 0b11  # two near bits of the first segment
    a, b = S.segment_keys(fp, near)[0], S.segment_keys(other, near)[0]
    assert len(set(a[:7].tolist()) & set(b[:7].tolist())) == 2
    assert a[7:].tolist() == b[7:].tolist() and len(set(a.tolist())) == S.SEGMENTS * (S.NEAR + 1)


def test_recall_of_the_keys_at_the_threshold():
    rng = np.random.default_rng(5)
    n, cos = 2000, 0.8 * 2 / 1.8
    x = rng.normal(size=(n, S.SIZE))
    y = cos * x + np.sqrt(1 - cos * cos) * rng.normal(size=x.shape)

    def keys(z):
        near = np.argpartition(np.abs(z[:, : S.KEYED]).reshape(n, S.SEGMENTS, S.BITS), S.NEAR - 1, axis=2)[:, :, : S.NEAR]
        return S.segment_keys(np.packbits(z > 0, axis=1, bitorder="little").view(np.int64), near.astype(np.uint8))

    met = [bool(set(p) & set(q)) for p, q in zip(keys(x).tolist(), keys(y).tolist())]
    assert np.mean(met) > 0.96


def test_appended_and_truncated_copies_of_short_texts(spark):
    rng = np.random.default_rng(21)
    texts, linked = [], []
    for a, b in [(4, 5), (5, 6), (6, 7), (12, 15), (14, 17), (20, 25), (28, 35), (60, 75), (100, 125), (128, 160), (4, 6), (11, 14), (59, 75)]:
        for k in range(12):
            w = [f"u{x}" for x in rng.integers(0, 1 << 40, b + 4)]
            short = [w[: a + 4], w[b - a :]][k % 2]
            texts += [" ".join(w), " ".join(short)][:: 1 - 2 * (k // 6)]
            linked.append(a >= 0.8 * b)
    got = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, texts)).collect()}
    assert [got[2 * i + 1] == got[2 * i] for i in range(len(linked))] == linked


def test_similarity_below_the_threshold_does_not_link(spark):
    rng = np.random.default_rng(22)
    texts = []
    for _ in range(40):
        w = [f"u{x}" for x in rng.integers(0, 1 << 40, 404)]
        texts += [" ".join(w), " ".join(w[: 4 + 316])]  # 316 of 400 shingles: 0.79
    got = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, texts)).collect()}
    assert got == {i: i for i in range(80)}


def test_recall_of_the_bands_at_the_threshold():
    rng = np.random.default_rng(23)
    for common in (4, 16, 64):
        for _ in range(300):
            h = rng.integers(0, 1 << 63, common * 5 // 4).astype(np.uint64)
            assert (S.band_codes(S.mix(h)) == S.band_codes(S.mix(h[:common]))).any()


def test_degenerate_texts(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    texts = ["", None, "  ", "one", "ONE", "two", "a b c d", "a b c d", "x " * 500, "x " * 600, long, long + " more", "é ü"]
    got = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, texts)).collect()}
    assert [got[i] for i in range(13)] == [0, 0, 0, 3, 3, 5, 6, 6, 8, 8, 10, 10, 12]


def test_null_and_repeated_ids_and_empty_table(spark):
    t = " ".join(f"v{i}" for i in range(50))
    rows = [(None, t), (4, t), (4, t), (2, t), (9, "other words here"), (None, "nobody else has this"), (9, "another text of nine")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.similar_groups(d).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (4, 2), (4, 2), (9, 9), (9, 9)]
    assert S.similar_groups(d.where("false")).count() == 0


def test_rows_are_dropped_by_themselves_not_by_their_ids(spark):
    t, u, v = (" ".join(f"{x}{i}" for i in range(50)) for x in "tuv")
    rows = [(1, t), (1, t), (2, u), (2, t), (None, u), (None, v), (None, v), (3, None), (4, ""), (5, u + " more")]
    d = spark.createDataFrame([(i, x, "k", 1, 2) for i, x in rows], "doc_id long, text string, __k1 string, k1 int, root int")
    kept = S.drop_similar(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, v), (1, t), (2, u)]
    assert [r.doc_id for r in kept.collect() if not r.text] == [3]
    assert S.drop_similar(d.where("false")).count() == 0


def test_links_beside_the_least_hub_join_components(spark):
    rng = np.random.default_rng(9)
    pairs = sorted({(int(max(p)), int(min(p))) for p in rng.integers(0, 300, (260, 2)) if p[0] != p[1]} | {(500, 400), (500, 450), (501, 450)})
    scratch = S.Scratch(spark)
    got = {r.node: r.root for r in S._joined(scratch.table(spark.createDataFrame(pairs, "a long, b long")), scratch).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(len(up)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up and got[501] == 400


def test_bitmap_of_repeated_keys(spark, monkeypatch):
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 32, 3000, dtype=np.int64) | (rng.integers(0, S.SEGMENTS + S.BANDS, 3000) << 32)
    for bits in (26, 8):
        monkeypatch.setattr(S, "SLOTS", 1 << bits)
        df = spark.createDataFrame([(int(k),) for k in keys], "key long")
        assert [r[0] for r in df.select(S._slot(F.col("key"))).collect()] == S._slot(keys).tolist()
        held = S.bitmap(df.limit(100).select(S._slot(F.col("key")).alias("s")))
        at = S._slot(keys[:100])
        assert S._set(held, at).all()
        assert 0 < np.bitwise_count(held.view(np.uint64)).sum() <= min(100, 1 << bits)


@pytest.mark.parametrize("whole", [8192, 3])
def test_rest_sends_a_text_once_to_a_component_not_to_each_bucket(spark, monkeypatch, whole):
    monkeypatch.setattr(S, "WHOLE", whole)
    texts = corpus()
    nodes = S.wide_fingerprints(table(spark, texts), "doc_id", "text", 5).withColumn("id", F.col("doc")).where("id < 10 OR id >= 40")
    met = nodes.select("id").crossJoin(spark.range(50).toDF("key"))
    comp = nodes.select(F.col("id").alias("node"), F.col("id").alias("root"))
    sizes = []

    class Counted(S.Scratch):
        def table(self, df):
            out = super().table(df)
            sizes.append(out.count())
            return out

    links = S._rest(met, nodes, comp, 0.8, Counted(spark)).collect()
    up = roots(len(texts), lambda i, j: any({i, j} == {r.a, r.b} for r in links))
    assert len({up[40 + 8 * b + k] for b in range(10) for k in range(3)} | {up[b] for b in range(10)}) == 10
    assert whole == 3 or max(sizes) <= nodes.count()


def test_rest_links_only_texts_that_share_an_open_bucket(spark):
    t = " ".join(f"v{i}" for i in range(60))
    nodes = S.wide_fingerprints(table(spark, [t, t.upper(), "x y z", t + " ", "p q r"]), "doc_id", "text", 5).withColumn("id", F.col("doc"))
    # 0 to 4 by their buckets: 1 and 3 are alike and meet in bucket 8, 0 and 1 are alike but meet nowhere
    met = spark.createDataFrame([(7, 0), (7, 2), (7, 4), (8, 1), (8, 2), (8, 3)], "key long, id long")
    comp = nodes.select(F.col("id").alias("node"), F.col("id").alias("root"))
    assert {frozenset((r.a, r.b)) for r in S._rest(met, nodes, comp, 0.8, S.Scratch(spark)).collect() if {r.a, r.b} <= {0, 1, 3}} == {frozenset((1, 3))}


def test_texts_that_stay_are_not_shuffled(spark):
    rng = np.random.default_rng(31)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 60, 600)) for _ in range(60)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, texts[0], texts[1]])], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    try:
        kept = S.drop_similar(d)
        began = written()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
        assert written() - began < 0.2 * sum(map(len, texts)) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_that_nobody_reads_are_removed(spark):
    scratch = S.Scratch(spark)
    a, b = (scratch.table(spark.range(n).toDF("x")) for n in (3, 4))
    path = a.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    scratch.clear(b)
    import os

    assert os.listdir(path) == ["2"] and b.count() == 4


def test_a_group_of_near_copies_does_not_meet_the_hub_of_each_bucket(spark, monkeypatch):
    rng = np.random.default_rng(41)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
    texts = []
    for _ in range(120):
        w = list(base)
        for p in rng.choice(400, 3, replace=False):
            w[p] = f"e{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    compared = []

    class Counted(S.Scratch):
        def table(self, df):
            out = super().table(df)
            if out.columns == ["a", "b"]:
                compared.append(out.count())
            return out

    monkeypatch.setattr(S, "Scratch", Counted)
    got = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, texts)).collect()}
    assert got == dict.fromkeys(range(120), 0)
    assert compared and max(compared) <= 2 * len(texts)


def test_hub_pairs_are_of_bands_and_of_buckets_of_two(spark):
    ball, band = 5, (S.SEGMENTS << 32) + 5
    met = [(1, ball, 3, 1), (2, ball, 3, 1), (3, ball, 3, 1), (4, ball + 1, 2, 4), (5, ball + 1, 2, 4), (1, band, 3, 1), (2, band, 3, 1), (6, band, 3, 1), (2, band + 1, 2, 1)]
    pairs = S.hub_pairs(spark.createDataFrame(met, "id long, key long, c long, hub long"))
    assert sorted(tuple(r) for r in pairs.collect()) == [(2, 1, 2), (5, 4, 1), (6, 1, 1)]
