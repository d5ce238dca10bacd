"""The pipeline's stages take effect, each on all that the one before kept."""

import numpy as np

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(11)
    kinds = {"en": ["the", "ing", "ou"], "de": ["ung", "ich", "sch"]}

    def say(k, n):
        return " ".join("".join(rng.choice(kinds[k], 3)) + f"{chr(97 + rng.integers(26))}" for _ in range(n))

    item = say("en", 50)
    rows = [(i, say(k, 60), k, f"s{i % 3}") for i, k in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[4][1], "en", "s1"), (201, "12 34 !?", "en", "s1"), (202, None, "de", "s1"), (203, say("en", 20) + " " + item, "en", "s2"), (204, "", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r[0] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    gone = []
    for name in list(stages)[:3]:
        docs = stages[name](spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        gone.append(left - now)
        left = now
    assert gone == [{201, 202, 204}, {200}, {203}]
    mixed = stages["mixing sources to target weights"](spark, docs, str(tmp_path))
    kept = {r.doc_id for r in mixed.collect()}
    assert kept < left and len(kept) > 20
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept and {r.shard for r in out} <= set(range(8))
    text = {r[0]: r[1] for r in rows}
    assert all(r.text == text[r.doc_id] and r.size == len(r.text.encode()) + 1 for r in out)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for stage in stages.values():
        none_left = stage(spark, none, str(tmp_path))
        assert none_left.count() == 0


def test_rows_without_ids_repeated_rows_clashing_names_and_very_long_texts(spark, tmp_path):
    rng = np.random.default_rng(12)

    def say(n):
        return " ".join("".join(rng.choice(["the", "ing", "ou"], 3)) + f"{chr(97 + rng.integers(26))}" for _ in range(n))

    item, long = say(40), say(60_000)
    rows = [(i, say(60), "en", f"s{i % 3}") for i in range(60)]
    leak = say(10) + " " + item
    rows += [(None, leak, "en", "s0"), (None, rows[3][1], "en", "s0"), (70, long, "en", "s1"), (71, long + " the", "en", "s1"), (70, say(50), "en", "s2"), (72, say(30), "en", "s2"), (None, say(45), None, None)]
    rows += [rows[5], rows[5], rows[-2]]
    docs = spark.createDataFrame([(*r, "mine", 0.5, 7, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, score string, coverage double, size int, __sampled string, shard int")
    spark.createDataFrame([(None, item), (5, "zz"), (6, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = docs
    for name in list(stages)[:3]:
        left = stages[name](spark, left, str(tmp_path))
        assert left.dtypes == docs.dtypes
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in left.collect())
    want = [(i, rows[i][1]) for i in range(60)] + [(-1, rows[66][1]), (70, long), (70, rows[64][1]), (72, rows[65][1])]
    assert got == sorted(want)
    assert {r.score for r in left.collect()} == {"mine"}
    mixed = stages["mixing sources to target weights"](spark, left, str(tmp_path))
    assert mixed.dtypes == docs.dtypes and 0 < mixed.count() < left.count()
    out = stages["sharding"](spark, left, str(tmp_path)).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in out) == got
    assert all(r.score == "mine" and r.size == len(r.text.encode()) + 1 for r in out)


def test_copies_and_leaks_of_every_kind_are_caught_and_clean_documents_kept(spark, tmp_path):
    rng = np.random.default_rng(13)

    def say(n):
        return [f"{''.join(rng.choice(['the', 'ing', 'ou', 'er'], 3))}{rng.integers(50)}" for _ in range(n)]

    base = [say(int(n)) for n in rng.integers(30, 400, 60)]
    copies = []
    for w in base[:40]:
        x = list(w)
        for p in rng.choice(len(x), max(1, len(x) // 60), replace=False):
            x[p] = "edited"
        copies.append(x)
    rows = [(i, " ".join(w)) for i, w in enumerate(base + copies)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")

    def alike(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
        return len(x & y) / len(x | y) >= 0.8

    gone = {60 + i for i, (a, b) in enumerate(zip(base, copies)) if alike(a, b)}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, str(tmp_path)).collect()}
    assert len(gone) > 20 and kept == {r[0] for r in rows} - gone
