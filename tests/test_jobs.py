"""The jobs over growing and repeated input, on copies; the registered queries hold their results against SQL."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import answer_audit, knowledge_feed
from jobs.common import settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"
LONG = " ".join(f"word{i}" for i in range(700))


def add(spark, path, rows):
    spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def chunks(spark, out):
    return sorted(map(str, knowledge_feed.current_chunks(spark, out).collect()))


def count(spark, path):
    return spark.read.parquet(path).count()


def test_feed_takes_only_what_is_new(spark, tmp_path):
    docs, out, cp = (str(tmp_path / x) for x in ("docs", "out", "cp"))
    first = [(i, f"Panduan {i}\nIsi dokumen {i} yang cukup panjang.", "id", "src") for i in range(20)]
    first += [(90, None, "id", "src"), (91, "", None, None), (92, LONG, "", "src"), (None, "No id", "id", "src"), first[0], first[0]]
    add(spark, docs, first)
    one = knowledge_feed.feed(spark, docs, out, cp)
    assert (one["batches"], one["rows"], one["rejected"], one["documents"]) == (1, 26, 1, 23)
    assert one["chunks"] == count(spark, f"{out}/chunks") == 20 + 4
    before = chunks(spark, out)
    again = knowledge_feed.feed(spark, docs, out, cp)
    assert again["batches"] == again["rows"] == 0 and chunks(spark, out) == before

    # one file more: new documents, a changed one, one that lost its text, and known ones as they were
    second = [(30, "Baru sama sekali.", "id", "src"), (1, "Cara lain\nTeks baru untuk dokumen satu.", "id", "src"), (92, "", "", "src"), first[2], first[3]]
    add(spark, docs, second)
    two = knowledge_feed.feed(spark, docs, out, cp)
    assert (two["batches"], two["rows"], two["documents"], two["chunks"]) == (1, 5, 3, 2)
    assert knowledge_feed.feed(spark, docs, out, cp)["rows"] == 0

    # the same state as from all documents at once
    final = {r[0]: r for r in first + second if r[0] is not None}
    whole, fresh = str(tmp_path / "whole"), str(tmp_path / "fresh")
    add(spark, whole, list(final.values()))
    knowledge_feed.feed(spark, whole, fresh, str(tmp_path / "cp2"))
    assert chunks(spark, fresh) == chunks(spark, out) and chunks(spark, out) != before
    bad = spark.read.parquet(f"{out}/rejected").collect()
    assert [(r["text"], r["reason"]) for r in bad] == [("No id", "doc_id is null")]


def test_feed_repeats_a_batch_without_doubling(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    add(spark, docs, [(i, f"Dokumen nomor {i} dengan isi.", "id", f"s{i}") for i in range(10)])
    knowledge_feed.feed(spark, docs, out, str(tmp_path / "cp"))
    before = chunks(spark, out)
    # as after a failure between the batch's writes and its commit
    knowledge_feed.take_batch(spark.read.parquet(docs), 0, out, knowledge_feed.DEFAULTS)
    assert chunks(spark, out) == before and count(spark, f"{out}/ledger") == 10 and count(spark, f"{out}/chunks") == 10


def test_feed_splits_batches_by_files(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    for i in range(3):
        add(spark, docs, [(1, f"Versi {i} dari dokumen.", "id", "s"), (10 + i, "Lain lagi isinya.", "id", "s")])
    got = knowledge_feed.feed(spark, docs, out, str(tmp_path / "cp"), {"files_per_batch": 1})
    assert got["batches"] == 3 and got["rows"] == 6
    assert knowledge_feed.current_chunks(spark, out).where("doc_id = 1").count() == 1


def test_feed_of_an_empty_table(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame([], DOCS).write.parquet(docs)
    assert knowledge_feed.feed(spark, docs, out, str(tmp_path / "cp"))["rows"] == 0
    assert chunks(spark, out) == []


def test_settings():
    assert settings({"a": 1, "b": False}, {"a": 2}) == {"a": 2, "b": False}
    for bad in ({"c": 1}, {"a": "x"}, {"b": 1}, {"a": True}):
        with pytest.raises(ValueError):
            settings({"a": 1, "b": False}, bad)


def test_audit_scores_and_repeats(spark, tmp_path):
    docs, turns, out = (str(tmp_path / x) for x in ("docs", "turns", "out"))
    add(spark, docs, [
        (0, "Ubah faskes lewat menu Ubah Data Peserta, pilih faskes baru, lalu simpan perubahan.", "id", "app"),
        (1, "Jadwal imunisasi anak ada di puskesmas setiap hari kerja.", "id", "app"),
        (2, None, None, None),
        (3, "", "id", "app"),
    ])
    said = [(1, 0, "user", "Bagaimana cara ubah faskes?"), (1, 1, "assistant", "Pilih menu Ubah Data Peserta, pilih faskes baru, lalu simpan perubahan."), (1, 2, "user", "zzz"), (1, 3, "assistant", None)]
    said += [(2, 0, "user", "Berapa dosis obat untuk saya?"), (2, 1, "assistant", "Minum ibuprofen 500 mg setiap hari."), (3, 0, "user", "sendiri"), (None, 0, "user", "x"), said[0], said[1]]
    spark.createDataFrame([(*r, "clash") for r in said], "conv_id long, turn long, role string, text string, route string").write.parquet(turns)
    one = answer_audit.audit(spark, turns, docs, out)
    rows = {(r["conv_id"], r["turn"]): r for r in one.collect()}
    assert sorted(rows) == [(1, 0), (1, 2), (2, 0)]
    assert rows[1, 0]["context_ids"][0] == 0 and rows[1, 0]["lexical_score"] > 0.9 and rows[1, 0]["route"] == "REVIEW"
    assert rows[1, 2]["context_ids"] == [] and rows[1, 2]["warnings"] == ["no_retrieved_context"] and rows[1, 2]["route"] == "REJECT"
    assert rows[2, 0]["route"] == "REJECT" and "individual_medical_advice_not_refused" in rows[2, 0]["hard_fails"]
    before = sorted(map(str, one.collect()))
    again = answer_audit.audit(spark, turns, docs, out, {"reuse_index": True})
    assert sorted(map(str, again.collect())) == before
    routes = {r["route"]: r["cases"] for r in spark.read.json(f"{out}/summary").collect()}
    assert routes == {"REVIEW": 1, "REJECT": 2}
    assert sorted(x for x in os.listdir(f"{out}/cases") if x.startswith("route=")) == ["route=REJECT", "route=REVIEW"]


def test_audit_of_empty_tables(spark, tmp_path):
    docs, turns = str(tmp_path / "docs"), str(tmp_path / "turns")
    spark.createDataFrame([], DOCS).write.parquet(docs)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(turns)
    assert answer_audit.audit(spark, turns, docs, str(tmp_path / "a")).collect() == []
    spark.createDataFrame([(1, 0, "user", "Apa?"), (1, 1, "assistant", "Tidak ada dokumen.")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(turns)
    only = answer_audit.audit(spark, turns, docs, str(tmp_path / "b")).collect()
    assert [(r["route"], r["context_ids"], r["warnings"]) for r in only] == [("REJECT", [], ["no_retrieved_context"])]


def test_command_line(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    add(spark, docs, [(1, LONG, "id", "s")])
    config = tmp_path / "feed.json"
    config.write_text(json.dumps({"max_words": 100, "overlap": 10}))
    run = [sys.executable, "-m", "jobs.knowledge_feed", "--documents", docs, "--out", out, "--checkpoint", str(tmp_path / "cp"), "--config", str(config)]
    for rows, n in ((1, 8), (0, 8)):
        done = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"{rows} rows" in done.stderr and count(spark, f"{out}/chunks") == n
    assert spark.read.parquet(f"{out}/chunks").agg(F.max("token_count_approx")).first()[0] == 100
    for name in ("knowledge_feed", "answer_audit"):
        given = json.loads(open(f"{ROOT}/jobs/{name}.json").read())
        assert given == {"knowledge_feed": knowledge_feed, "answer_audit": answer_audit}[name].DEFAULTS
