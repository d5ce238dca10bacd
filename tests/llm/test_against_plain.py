"""Decontamination and language ID as a whole against plain forms of the same rules."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.decontam import contaminated_passages, drop_contaminated
from quire.llm.langid import fit_languages, identify_language


def align(a, b):
    """Best local alignment score of two word lists: match 2, mismatch and gap -1."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
            best = max(best, new[-1])
        row = new
    return best


def zipf_words(rng, n, vocabulary=3000):
    return [f"v{min(int(x), vocabulary)}" for x in rng.zipf(1.25, n)]


@pytest.mark.parametrize("prose", ["uniform", "zipf"])
def test_decontamination_equals_plain_alignment(spark, prose):
    rng = np.random.default_rng(11)
    draw = (lambda n: zipf_words(rng, n)) if prose == "zipf" else (lambda n: [f"u{x}" for x in rng.integers(0, 2000, n)])
    items = [draw(int(rng.integers(8, 30))) for _ in range(40)]
    docs = [draw(int(rng.integers(20, 160))) for _ in range(60)]
    for k, item in enumerate(items[:30]):
        copy = list(item)
        for _ in range(len(copy) * (k % 4) // 12):
            at = int(rng.integers(len(copy)))
            if k % 2:
                copy[at] = "edited"
            else:
                del copy[at]
        at = int(rng.integers(0, 15))
        docs[k] = docs[k][:at] + copy + docs[k][at:]
    texts = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(None, None), (90, ""), (91, " ".join(items[0])), (91, " ".join(items[0]))]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(70, None), (71, "")]
    df, it = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_passages(df, it).collect()}
    want = {(d, i) for d, t in texts for i, w in enumerate(items) if align(w, (t or "").split()) >= len(w)}
    lacking = {(d, i) for d, i in want - got if not _shares_seed(items[i], dict(texts[:60]).get(d, texts[-1][1]).split())}
    assert got <= want and want - got == lacking and len(got) >= 25
    clean = [r["text"] for r in drop_contaminated(df, it).collect()]
    assert sorted(map(str, clean)) == sorted(str(t) for d, t in texts if d not in {x for x, _ in got})


def _shares_seed(item, doc, n=3):
    grams = {tuple(doc[i : i + n]) for i in range(len(doc))}
    return any(tuple(item[i : i + n]) in grams for i in range(len(item) - n + 1))


def grams_of(text, n=4):
    fold = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in b" " + text.encode() + b" ")
    # upper case of the Latin-1 letters
    fold = bytes(b + 32 if i and fold[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b for i, b in enumerate(fold))
    return [g for i in range(len(fold) - n + 1) if (g := fold[i : i + n]) != b" " * n]


def test_language_id_follows_plain_sets(spark):
    rng = np.random.default_rng(12)
    syllables = {"aa": "ka ri mo tu na", "bb": "sch ung keit ver", "cc": "ção lha nho que", "dd": "ka ri mo sch"}
    rows = []
    for i in range(400):
        lang = sorted(syllables)[i % 4]
        parts = syllables[lang].split()
        text = " ".join("".join(parts[int(x)] for x in rng.integers(0, len(parts), int(rng.integers(1, 4)))).capitalize() for _ in range(int(rng.integers(1, 60))))
        rows.append((i, text, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = df.where("doc_id < 300")
    got = {r["doc_id"]: r for r in identify_language(df, fit_languages(train)).collect()}
    # the same rule with plain sets: an n-gram is a language's if its rate there is at least a quarter of its highest rate
    counts = {k: Counter(g for i, t, lang in rows[:300] if lang == k for g in grams_of(t)) for k in sorted(syllables)}
    total = {k: sum(c.values()) for k, c in counts.items()}
    best = {g: max(counts[k][g] / total[k] for k in counts) for c in counts.values() for g in c}
    sets = {k: {g for g in counts[k] if counts[k][g] / total[k] >= 0.25 * best[g]} for k in counts}
    close = 0
    for i, text, _ in rows:
        hits = {k: sum(g in sets[k] for g in grams_of(text)) for k in sorted(sets)}
        top = sorted(hits.values())[::-1]
        if top[0] - top[1] <= 0.02 * top[0] + 1:
            close += 1  # false positives of the filters may decide
            continue
        assert got[i]["lang_pred"] == max(hits, key=hits.get), (text, hits)
        assert abs(got[i]["score"] - top[0] / sum(hits.values())) < 0.05
    assert close < 120


def test_language_id_of_odd_tables(spark):
    rows = [(i, "satu dua tiga empat" if i % 2 else "eins zwei drei vier", "id" if i % 2 else "de", "x") for i in range(40)]
    rows += [rows[0], rows[0], (90, "satu dua tiga " * 40_000, "id", "x"), (91, "12 34", "de", "x"), (None, "satu dua", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, coverage string")
    out = identify_language(df, fit_languages(df.where("doc_id < 40")))
    got = out.collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] == 0} == {"de"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (90, None)} == {"id"} and [r["lang_pred"] for r in got if r["doc_id"] == 91] == ["und"]
    # a text of n-grams that both know alike goes to the first in alphabetical order
    same = spark.createDataFrame([(1, "abcd efgh", "y"), (2, "abcd efgh", "x")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify_language(same, fit_languages(same)).collect()} == {"x"}
    assert out.where(F.col("coverage") > 1).count() == 0
