"""Bad bytes, ordered files, ordinals, pruning of long lists, semantic scores in a run, the chat client's settings."""

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import generation, index, ordering, retrieval
from quire.plans import pipeline
from quire.sources import io


def test_bad_bytes_fail_no_file(spark):
    raw = {
        "a.html": ("<html><p>caf\xe9 noir &amp; th\xe9</p></html>".encode("latin-1"), "html"),
        "b.txt": ("d\xe9j\xe0 vu\nfin".encode("latin-1"), "text"),
        "c.txt": ("Isi berkas".encode("utf-16"), "text"),
        "d.pdf": (b"%PDF caf\xe9 broken", "pdf"),
        "e.txt": ("Teks ñandú 日本 � utuh".encode(), "text"),
        "f.txt": (b"potong \xe6\x97", "text"),
        "g.txt": (b"\xff\xfe", "text"),
    }
    cat = spark.createDataFrame([tuple(n if c == "local_path" else n[0] if c == "doc_id" else "" for c in io.CATALOG_COLUMNS) for n in raw], [*io.CATALOG_COLUMNS])
    files = spark.createDataFrame([(n, bytearray(b), k) for n, (b, k) in raw.items()], "local_path string, content binary, kind string")

    def reader(_):
        raise ValueError("no trailer")

    got = {r.doc_id: r.text for r in io.extract_documents(cat, files, reader).collect()}
    assert got == {
        "a": "caf noir & th", "b": "dj vu\nfin", "c": raw["c.txt"][0].decode("utf-8", "ignore"), "d": "%PDF caf broken", "e": "Teks ñandú 日本 � utuh", "f": "potong"
    }


def test_ordered_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k), f"t{k}") for k in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "ord long, text string").repartition(5)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        io.write_jsonl(df, str(tmp_path / "out"), order="ord")
    finally:
        spark.conf.unset(merged)
    files = sorted(p for p in (tmp_path / "out").glob("part-*"))
    read = [json.loads(x)["text"] for p in files for x in p.read_text().splitlines()]
    assert read == [f"t{k}" for k in range(3000)] and len(files) > 1


def test_ordinals(spark):
    rng = np.random.default_rng(2)
    values = [None if x == 7 else int(x) for x in rng.integers(0, 12, 2000)]
    df = spark.createDataFrame([(v, i, "c") for i, v in enumerate(values)], "v long, i long, __place string").repartition(6)
    got = sorted(ordering.numbered(df, ["v"], "n").collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(2000)) and sorted(r["i"] for r in got) == list(range(2000))
    assert [r["v"] for r in got] == sorted(values, key=lambda v: (v is not None, v or 0)) and {r["__place"] for r in got} == {"c"}
    assert ordering.numbered(df.limit(0), ["v"], "n").collect() == []
    exact = [r["i"] for r in sorted(ordering.numbered(df, ["v", "i"], "n").collect(), key=lambda r: r["n"])]
    assert exact == sorted(range(2000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    right = spark.createDataFrame([(f"r{k:02d}",) for k in range(30)], "w string")
    zipped = ordering.zip_by_order(df.withColumnRenamed("v", "__n"), right, "i", "w").collect()
    assert sorted((r["i"], r["w"]) for r in zipped) == [(k, f"r{k:02d}") for k in range(30)]


def fold(texts, tokens, chars):
    seen, used, spent, out = set(), 0, 0, []
    for p, t in texts:
        kept = []
        for line in re.split(r"\r\n|[\n\r]", t or ""):
            line = re.sub(r"\s+", " ", line).strip()
            if len(line) >= 3 and not re.fullmatch(r"[\W_]+", line) and line.lower() not in seen:
                seen.add(line.lower())
                kept.append(line)
        clean = "\n".join(kept)
        if not clean:
            continue
        if tokens - used <= 0 or chars - spent <= 0:
            break
        words = clean.split()
        cut = (" ".join(words[: tokens - used]) if len(words) > tokens - used else clean)[: chars - spent]
        used, spent = used + len(re.findall(r"\w+", cut)), spent + len(cut)
        out.append((p, cut))
    return out


def test_pruning_equals_a_fold_and_takes_long_lists(spark):
    rng = np.random.default_rng(3)
    lists = {q: [(p, "\n".join(" ".join(f"W{rng.integers(6)}" if rng.random() < 0.9 else "--" for _ in range(int(rng.integers(0, 4)))) for _ in range(int(rng.integers(0, 9))))) for p in range(6)] for q in range(60)}
    lists[60] = [(0, None), (1, ""), (2, "Satu\nsatu\r\nSATU dua"), (3, "satu")]
    lists[61] = [(p, "\n".join(f"baris {p} nomor {i}" for i in range(200))) for p in range(100)]  # 20,000 lines
    df = spark.createDataFrame([(q, p, t) for q, x in lists.items() for p, t in x], "q int, p int, t string")
    for tokens, chars in ((15, 60), (1 << 20, 1 << 22)):
        got = {}
        for r in retrieval.prune_context(df, "q", "p", "t", tokens, chars).orderBy("q", "p").collect():
            got.setdefault(r["q"], []).append((r["p"], r["text"]))
        assert got == {q: want for q, x in lists.items() if (want := fold(x, tokens, chars))}


def _vector(text):
    return np.array([1e-3 + text.lower().count(w) for w in ("iuran", "kelas", "klaim", "alamat")])


def test_semantic_scores_of_a_run_equal_brute_force(spark, tmp_path):

    def load():
        # workers cannot import this module
        return lambda texts: [[1e-3 + t.lower().count(w) for w in ("iuran", "kelas", "klaim", "alamat")] for t in texts]

    encode = index.encoder(load, 2)
    texts = ["Besaran iuran kelas satu.", "Pengajuan klaim di rumah sakit.", "Ubah alamat peserta.", "Iuran dan alamat kelas dua."]
    docs = [(f"D{i}", None, None, "https://kemkes.go.id/", t, i + 1) for i, t in enumerate(texts)]
    chunks = pipeline.build_chunk_table(spark.createDataFrame(docs, "doc_id string, title string, section string, source_url string, text string, doc_ord long"), str(tmp_path / "c"))
    idx = index.HybridIndex.build(chunks, str(tmp_path / "index"), encode, "m")
    ids = {r.doc_id: r.chunk_id for r in chunks.collect()}
    asked = [("Q1", "Iuran kelas satu ditetapkan.", ["D1", "D0"]), ("Q2", "Klaim di rumah sakit.", ["D1", "D3", "D2"]), ("Q3", "Alamat baru.", []), ("Q4", None, ["D0"])]
    cases = spark.createDataFrame([(q, "tanya", a, [*(ids[d] for d in c), "unknown"], "REVIEW") for q, a, c in asked], "question_id string, question string, answer string, retrieved_context_ids array<string>, expected_route string")
    results, _ = pipeline.run_eval(spark, cases, chunks, str(tmp_path / "out"), index=idx)
    rows = {r.question_id: r for r in results.collect()}
    # a chunk is embedded with all that is searched
    searched = {r.doc_id: _vector(r.s) for r in chunks.select("doc_id", index.search_text().alias("s")).collect()}
    for q, a, c in asked:
        v = _vector(a or "")
        want = max((float(v @ searched[d] / np.linalg.norm(v) / np.linalg.norm(searched[d])) for d in c), default=0.0)
        assert abs(rows[q].semantic_score - want) < 1e-3
        assert abs(rows[q].attribution_score - (0.6 * want + 0.4 * rows[q].lexical_score)) < 2e-3
    assert rows["Q1"].semantic_score > 0.9 and rows["Q3"].semantic_score == 0.0
    assert "__semantic" not in results.columns
    plain, _ = pipeline.run_eval(spark, cases, chunks)
    assert {r.semantic_score for r in plain.collect()} == {0.0}


def test_chat_client_from_the_environment(monkeypatch):
    for name in ("CHAT_API_KEY", "CHAT_BASE_URL", "CHAT_MODEL"):
        monkeypatch.delenv(name, raising=False)
    by = {"tp-": "https://plan.example/v1", "sk-": "https://api.example/v1"}
    make = lambda: generation.ChatClient.from_env(by, "https://default.example/v1", "small")
    with pytest.raises(RuntimeError, match="CHAT_API_KEY"):
        make()
    for key, url in (("tp-1", by["tp-"]), ("sk-1", by["sk-"]), ("other", "https://default.example/v1")):
        monkeypatch.setenv("CHAT_API_KEY", key)
        assert (make().api_key, make().base_url, make().model) == (key, url, "small")
    monkeypatch.setenv("CHAT_BASE_URL", "https://mine.example/v1/")
    monkeypatch.setenv("CHAT_MODEL", "large")
    assert (make().base_url, make().model) == ("https://mine.example/v1/", "large")
    assert make().payload([])["temperature"] == 0.0


def test_downloads_spare_each_host(spark, tmp_path):
    log: list[tuple[str, str, float]] = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            log.append((self.headers["Host"].split(":")[0], self.path, time.time()))
            again = sum(p == self.path for _, p, _ in log) > 1
            if self.path == "/gone" or (self.path == "/flaky" and not again):
                self.send_error(503)
                return
            body = {"/a.pdf": b"<a href='x.html'>x</a> <a href='files/b.PDF'>b</a>", "/files/b.PDF": b"%PDF-1.4"}.get(self.path, self.path.encode())
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    site = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    names = ["a.pdf", "flaky", "gone", "c", "d", "e"]
    rows = [(f"{h}/{n}", f"http://{h}:{site.server_port}/{n}") for h in ("127.0.0.1", "localhost") for n in names]
    catalog = spark.createDataFrame([*rows, ("null.txt", None)], "local_path string, source_url string").repartition(6)
    got = {r["local_path"]: r for r in io.download_missing(catalog, spark.createDataFrame([("localhost/e",)], "local_path string"), pause=0.05, tries=2).cache().collect()}
    site.shutdown()
    assert len(got) == 12 and bytes(got["127.0.0.1/a.pdf"]["content"]) == b"%PDF-1.4" == bytes(got["localhost/a.pdf"]["content"])
    assert got["localhost/c"]["status"] == "ok" and bytes(got["localhost/c"]["content"]) == b"/c"
    assert all(got[f"{h}/gone"]["status"].startswith("failed: ") and got[f"{h}/gone"]["content"] is None for h in ("127.0.0.1", "localhost"))
    assert got["127.0.0.1/flaky"]["status"] == got["localhost/flaky"]["status"] == "ok" and got["null.txt"]["status"].startswith("failed")
    for h in ("127.0.0.1", "localhost"):
        times = sorted(t for x, _, t in log if x == h)
        assert min(b - a for a, b in zip(times, times[1:])) > 0.04, sorted((t, x, p) for x, p, t in log)
