"""Extraction of tables, the hybrid index, the live engine and the runners, with stand-ins for libraries that are not installed."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import index
from quire.plans import pipeline
from quire.sources import io

ROWS = [["Jenis", "Iuran"], ["Kelas 1", "150000"], ["Kelas 2", "100000"]]
CASES = "question_id string, question string, reference_answer string, expected_context_ids array<string>, expected_route string"


def _files(spark, rows):
    cat = spark.createDataFrame([tuple(n if c == "local_path" else f"D{i}" if c == "doc_id" else "" for c in io.CATALOG_COLUMNS) for i, (n, _, _) in enumerate(rows)], [*io.CATALOG_COLUMNS])
    return cat, spark.createDataFrame([(n, bytearray(b), k) for n, b, k in rows], "local_path string, content binary, kind string")


def test_pdf_tables_and_fallbacks(spark):
    def reader(raw):
        if b"broken" in raw:
            yield 1, "text", "lost with the rest"
            raise ValueError("no trailer")
        yield from [(1, "text", " Satu  "), (1, "table", ROWS), (1, "table", [["-", ""]]), (1, "table", [[x.upper() for x in r] for r in ROWS]), (2, "table", ROWS), (3, "text", " ")]

    cat, files = _files(spark, [("a.pdf", b"%PDF-a", "pdf"), ("b.pdf", b"%PDF <HTML><nav>x</nav><p>Isi &amp; lain</p> broken", "pdf"), ("c.pdf", b"%PDF broken", "pdf"), ("d.txt", b"x", "text"), ("e.txt", b"", "text")])
    got = {(r.doc_id, r.page, r.table_index): r for r in io.extract_documents(cat, files, reader).collect()}
    assert set(got) == {("D0", 1, None), ("D0", 1, 1), ("D0", 2, 1), ("D1", None, None), ("D2", None, None), ("D3", None, None)}
    table = got["D0", 1, 1]
    assert (table.section, table.subtitle, table.chunk_type) == ("Tabel 1 halaman 1", "Tabel 1", "table") and table.text == table.content
    assert table.text.startswith("Tabel 1 halaman 1\n| Jenis | Iuran |") and "Baris 1: Jenis: Kelas 1 | Iuran: 150000" in table.text
    assert got["D0", 1, None].text == "Satu" and got["D3", None, None].text == "x"
    assert "Isi & lain" in got["D1", None, None].text and "<p>" not in got["D1", None, None].text and "no trailer" in got["D1", None, None].error
    assert got["D2", None, None].text == "%PDF broken"
    assert io.pdf_pages(io.extract_documents(cat, files, reader)).count() == 3


def _encode(tmp_path):
    """Counts of some words as vectors; each batch leaves a note of its texts."""
    log = str(tmp_path)

    def load():
        import uuid

        def model(texts):
            Path(log, uuid.uuid4().hex + ".asked").write_text("\n".join(x.replace("\n", " ") for x in texts))
            return [[1e-3 + x.lower().count(w) for w in ("iuran", "kelas", "klaim", "alamat")] for x in texts]

        return model

    return index.encoder(load, 2)


def _asked(tmp_path):
    notes = list(tmp_path.glob("*.asked"))
    out = [line for n in notes for line in n.read_text().splitlines()]
    for n in notes:
        n.unlink()
    return out


def _chunks(spark, tmp_path, texts):
    rows = [(f"D{i}", f"T{i}", None, "https://kemkes.go.id/", t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, title string, section string, source_url string, text string, doc_ord long")
    return pipeline.build_chunk_table(df, str(tmp_path))


TEXTS = ["Besaran iuran kelas satu.", "Pengajuan klaim di rumah sakit.", "Ubah alamat peserta.", "Jadwal layanan kantor cabang."]


def test_index_encodes_only_what_the_cache_lacks(spark, tmp_path):
    encode, at = _encode(tmp_path), str(tmp_path / "index")
    one = _chunks(spark, tmp_path / "c1", TEXTS)
    assert index.build_index(one, at, encode, "m").count() == 4 and len(_asked(tmp_path)) == 4
    assert index.build_index(one, at, encode, "m").count() == 4 and not _asked(tmp_path)
    two = _chunks(spark, tmp_path / "c2", [*TEXTS[:3], "Jadwal baru."])
    assert index.build_index(two, at, encode, "m").count() == 4 and len(_asked(tmp_path)) == 1
    assert index.build_index(two, at, encode, "other").count() == 4 and len(_asked(tmp_path)) == 4
    size = index.build_index(two, at, encode, "m", recreate=True).select(F.aggregate(F.transform("embedding", lambda x: (x * x).cast("double")), F.lit(0.0), lambda a, x: a + x).alias("n"))
    assert all(abs(r.n - 1) < 1e-5 for r in size.collect()) and spark.read.parquet(at).count() == 4


def test_live_engine_and_runner(spark, tmp_path):
    encode = _encode(tmp_path)
    chunks = _chunks(spark, tmp_path / "c", TEXTS)
    chunks.write.json(str(tmp_path / "jsonl"))
    idx = index.HybridIndex.from_jsonl(spark, str(tmp_path / "jsonl"), chunks.schema, str(tmp_path / "index"), encode, "m")
    ids = [r.chunk_id for r in chunks.orderBy("doc_id").collect()]
    cases = spark.createDataFrame([("Q1", "Berapa iuran kelas satu?", TEXTS[0], [ids[0]], "REVIEW"), ("Q2", "cara klaim", TEXTS[1], [ids[1]], "REVIEW")], CASES)
    top = {r.question_id: r.chunk_id for r in idx.retrieve(cases, "question_id", "question", 2).where("position = 1").collect()}
    assert top == {"Q1": ids[0], "Q2": ids[1]}

    def transport(chat):
        return json.dumps({"exact_quote": "", "final_answer": "Besaran iuran kelas satu." if "iuran" in chat[1]["content"] else "Pengajuan klaim di rumah sakit."})

    live = pipeline.live_answers(cases, idx, transport, top_k=2)
    results, summary, passed = pipeline.run_experiment(spark, live, str(tmp_path / "out"), strict=True)
    rows = {r.question_id: r for r in results.collect()}
    assert [rows[q].retrieved_context_ids[0] for q in ("Q1", "Q2")] == ids[:2] and rows["Q1"].attribution_score > 0
    assert summary.first().total_cases == 2 and passed == all(r["pass"] for r in rows.values())
    trace = spark.read.json(str(tmp_path / "out/debug")).where("question_id = 'Q1'").first()
    assert trace.answer == TEXTS[0] and trace.contexts[0].chunk_id == ids[0] and trace.contexts[0].text_preview == TEXTS[0]


def test_stages_of_the_quick_run(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.txt").write_text("Besaran iuran kelas satu adalah tetap.")
    (tmp_path / "cat.csv").write_text(",".join(io.CATALOG_COLUMNS) + "\nD1,A,,,,,,,,a.txt,,,,,\n")
    got = pipeline.extract_stage(spark, str(tmp_path / "cat.csv"), str(tmp_path / "raw"), str(tmp_path / "docs"))
    assert got.first().text == "Besaran iuran kelas satu adalah tetap."
    schema = "doc_id string, title string, section string, source_url string, text string, doc_ord long"
    chunks = pipeline.chunk_stage(spark, str(tmp_path / "docs"), str(tmp_path / "none"), schema, str(tmp_path / "chunks"))
    assert chunks.count() == 1
    cases = spark.createDataFrame([("Q1", "iuran", "Besaran iuran kelas satu.", [chunks.first().chunk_id], "REVIEW")], CASES)
    with pytest.raises(RuntimeError, match="stage verify failed after .*evaluate"):
        pipeline.quick_run(cases, chunks, io.read_catalog(spark, str(tmp_path / "cat.csv")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 1
