"""Registered queries of the document-QA engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import html, lexicon as lx, text as tx
from quire.operators import chunking, generation, inverted, ordering, reporting, retrieval, router, scoring, tables
from quire.sources import io

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark, sf, name) -> DataFrame:
    return io.spread(spark.read.parquet(f"{sf}/{name}.parquet"))


# --- SQL fragments ---------------------------------------------------------------------
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def q_clean(c):
    return STRIP.format(rf"regexp_replace(regexp_replace(regexp_replace({c}, '\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def q_retrieval(c, stopwords=lx.RETRIEVAL_STOPWORDS):
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^a-zA-Z0-9À-ÿ]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND NOT list_contains({_list(stopwords)}, x))"


def q_evidence(c):
    return f"list_filter(list_transform(string_split(regexp_replace(lower({c}), '[^a-z0-9A-ZÀ-ÿ/.-]+', ' ', 'g'), ' '), lambda x: trim(x, '.-/')), lambda x: length(x) > 2 AND NOT list_contains({_list(lx.EVIDENCE_STOPWORDS)}, x))"


def q_claims(c):
    parts = rf"string_split_regex(regexp_replace({STRIP.format(c)}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')"
    return f"list_transform(list_filter({parts}, lambda x: length({STRIP.format('x')}) >= 12), lambda x: trim(x, ' -•' || chr(9)))"


def q_match(c, pattern):
    """Boolean search of a pattern between word boundaries, for any script."""
    body = pattern.replace(r"\b", "").replace("'", "''")
    return rf"regexp_matches(lower({c}), '(^|[^\p{{L}}\p{{N}}_]){body}($|[^\p{{L}}\p{{N}}_])')"


def q_any(c, patterns):
    return "(" + " OR ".join(q_match(c, p) for p in patterns) + ")"


def q_numbers(c):
    return rf"list_transform(regexp_extract_all(lower({c}), '\d+(?:[.,]\d+)?(?:\s*(?:mg|mcg|gram|g|ml|hari|bulan|tahun|kali|%))?\b'), lambda x: x)"


# --- text functions --------------------------------------------------------------------
@_query(f"SELECT doc_id, {q_clean('text')} AS clean FROM documents")
def clean_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.clean_text("text").alias("clean"))


@_query("SELECT doc_id, substr(upper(trim(regexp_replace(CASE WHEN text = '' THEN 'chunk' ELSE text END, '[^A-Za-z0-9]+', '_', 'g'), '_')), 1, 48) AS id FROM documents")
def norm_id(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.norm_id("text").alias("id"))


HEADED = "concat('Panduan ', source, chr(10), text, chr(10), '2. Langkah', chr(10), lang, chr(10), upper(concat('bagian akhir ', source)), chr(10), source)"
Q_HEAD = r"(regexp_matches(l, '(?i)^(BAB\s+[IVXLC]+|[0-9]+[.)]\s+|Panduan\s+|Cara\s+|Fitur\s+)') OR regexp_matches(l, '^[A-Z0-9 ,/()\-]{8,}$'))"


def q_lines(text):
    return f"SELECT doc_id, list_filter(list_transform(string_split({q_clean(text)}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ls FROM documents"


Q_LINES = q_lines(HEADED)


def _headed(docs):
    return docs.withColumn("text", F.expr(HEADED.replace("chr(10)", r"'\n'")))


@_query(f"SELECT doc_id, len(list_filter(ls, lambda l: {Q_HEAD})) AS headings, len(ls) AS n_lines FROM ({Q_LINES})")
def heading_lines(spark, sf):
    d = _headed(_t(spark, sf, "documents"))
    lines = F.filter(F.transform(F.split(tx.clean_text("text"), r"\n"), tx.strip), lambda x: x != "")
    return d.select("doc_id", F.size(F.filter(lines, lambda x: tx.is_heading(x))).cast("long").alias("headings"), F.size(lines).cast("long").alias("n_lines"))


@_query(f"SELECT doc_id, array_to_string({q_retrieval('text')}, ' ') AS tokens FROM documents")
def tokenize_retrieval(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(tx.tokenize_retrieval("text"), " ").alias("tokens"))


@_query(f"SELECT doc_id, array_to_string({q_evidence('text')}, ' ') AS tokens FROM documents")
def tokenize_evidence(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(tx.tokenize_evidence("text"), " ").alias("tokens"))


@_query(f"SELECT doc_id, array_to_string({q_claims('text')}, '|') AS claims FROM documents")
def claims_split(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(tx.claims("text"), "|").alias("claims"))


NUMBERED = "concat(text, ' minum 500 mg, 2,5ml 50% ', CAST(conv_id AS VARCHAR), ' hari')"


@_query(f"SELECT conv_id, turn, array_to_string({q_numbers(NUMBERED)}, '|') AS numbers FROM conversations")
def numeric_tokens(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("text", F.expr(NUMBERED.replace("VARCHAR", "STRING")))
    return c.select("conv_id", "turn", F.array_join(tx.numeric_tokens("text"), "|").alias("numbers"))


@_query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_tokens FROM documents")
def token_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.approx_tokens("text").cast("long").alias("n_tokens"))


@_query(r"""SELECT page_id, h AS host, (h = 'example.org' OR ends_with(h, '.example.org') OR h = 'example.net' OR ends_with(h, '.example.net')) AS official
FROM (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS h FROM pages)""")
def official_urls(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", tx.host("url").alias("host"), tx.is_official_url("url", ["example.org", "example.net"]).alias("official"))


SAID = (
    "concat(text, CASE turn % 4 WHEN 0 THEN ' Berapa dosis obat ibuprofen 500 mg?' WHEN 1 THEN ' Anda harus konsultasi ke dokter. Diagnosis saya jelas.' "
    "WHEN 2 THEN ' Hal itu *tidak tersedia* dalam konteks resmi; informasi lebih lanjut di situs resmi.' ELSE '' END)"
)
Q_PLAIN = f"regexp_replace(lower({SAID}), '[*_`]+', '', 'g')"


@_query(f"""SELECT conv_id, turn, {q_any(SAID, lx.MEDICAL_ADVICE)} AS advice, ({' OR '.join(f"contains(lower({SAID}), '{m}')" for m in lx.REFUSALS)}) AS refusal,
{q_any(SAID, lx.UNSAFE_CLAIMS)} AS unsafe, {q_any(SAID, lx.EXPLICIT_CLAIMS)} AS explicit,
(contains({Q_PLAIN}, 'tidak tersedia dalam konteks') OR contains({Q_PLAIN}, 'tidak tersedia') AND contains({Q_PLAIN}, 'konteks resmi')) AS insufficient,
(contains({Q_PLAIN}, 'informasi lebih lanjut') AND contains({Q_PLAIN}, 'situs resmi')) AS neutral FROM conversations""")
def safety_flags(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("text", F.expr(SAID))
    return c.select(
        "conv_id", "turn", tx.any_match("text", lx.MEDICAL_ADVICE).alias("advice"), tx.any_contains("text").alias("refusal"),
        tx.any_match("text", lx.UNSAFE_CLAIMS).alias("unsafe"), tx.any_match("text", lx.EXPLICIT_CLAIMS).alias("explicit"),
        tx.declares_insufficient("text").alias("insufficient"), tx.is_neutral("text").alias("neutral"),
    )


ASKED = (
    "concat(CASE item_id % 5 WHEN 0 THEN 'Berapa jumlah FKTP di ' WHEN 1 THEN 'Bagaimana cara ubah faskes ' WHEN 2 THEN 'Apa perbedaan ' "
    "WHEN 3 THEN 'Daftar obat Fornas ' ELSE '' END, text)"
)


def q_expanded(c):
    return f"concat_ws(' ', {c}, {', '.join(f'CASE WHEN {q_match(c, p)} THEN {chr(39)}{s}{chr(39)} END' for p, s in lx.QUERY_EXPANSIONS)})"


Q_EXPANDED = q_expanded(ASKED)


@_query(f"SELECT item_id, {Q_EXPANDED} AS query FROM benchmark")
def expand_queries(spark, sf):
    return _t(spark, sf, "benchmark").withColumn("text", F.expr(ASKED)).select("item_id", tx.expand_query("text").alias("query"))


def _q_scores(rules):
    return "greatest(0.0, " + ", ".join(f"CASE WHEN {q_match('q', p)} THEN {w} ELSE 0.0 END" for p, w in rules) + ")"


@_query(f"""WITH s AS (SELECT item_id, CAST({_q_scores(lx.COMPUTATIONAL)} AS DOUBLE) AS c, CAST({_q_scores(lx.FACTUAL)} AS DOUBLE) AS f FROM (SELECT item_id, {ASKED} AS q FROM benchmark))
SELECT item_id, CASE WHEN c >= 0.6 AND c > f THEN 'computational' WHEN f >= 0.5 THEN 'factual' ELSE 'unknown' END AS intent,
CASE WHEN c >= 0.6 AND c > f THEN c WHEN f >= 0.5 THEN f ELSE greatest(c, f) END AS confidence,
CASE WHEN c >= 0.6 AND c > f THEN 'computational' ELSE 'retrieval' END AS processing_path,
CASE WHEN c >= 0.6 AND c > f THEN 'table' ELSE 'text,table' END AS types FROM s""")
def route_queries(spark, sf):
    b = _t(spark, sf, "benchmark").withColumn("text", F.expr(ASKED)).select("item_id", router.route_query("text").alias("r"))
    return b.select("item_id", "r.intent", F.col("r.confidence").cast("double").alias("confidence"), "r.processing_path", F.array_join("r.filter_chunk_types", ",").alias("types"))


@_query(r"""SELECT page_id, """ + q_clean(r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', chr(10), 'g')") + " AS text FROM pages")
def html_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


@_query()
def html_text_dom(spark, sf):
    return _t(spark, sf, "pages").select("page_id", html.html_text_dom(F.col("html")).alias("text"))


@_query(r"""SELECT page_id, list_filter(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda u: contains(lower(u), 'th') OR contains(lower(u), '.pdf'))[1] AS link FROM pages""")
def html_links(spark, sf):
    return _t(spark, sf, "pages").select("page_id", html.first_download_link(F.col("html"), ["th", ".pdf"]).alias("link"))


@_query(r"""SELECT page_id, CASE WHEN starts_with(r, '%PDF') THEN 'pdf' WHEN starts_with(lower(r), '<!doctype') OR contains(lower(r), '<html') OR regexp_matches(lower(url), '\.html?$') THEN 'html' ELSE 'text' END AS kind
FROM (SELECT page_id, url, ltrim(CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN concat('%PDF-1.4 ', url) ELSE url END, chr(10) || ' ') AS r FROM pages)""")
def file_kind(spark, sf):
    p = _t(spark, sf, "pages").withColumn("raw", F.expr("CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN concat('%PDF-1.4 ', url) ELSE url END"))
    return p.select("page_id", html.file_kind(F.encode("raw", "UTF-8"), F.col("url")).alias("kind"))


# --- chunking --------------------------------------------------------------------------
def q_sections(lines):
    return f"""l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM ({lines})),
g AS (SELECT doc_id, l, pos, {Q_HEAD} AS h, sum(CASE WHEN {Q_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM l),
sec AS (SELECT doc_id, coalesce(max(CASE WHEN h THEN substr(l, 1, 140) END), 'General') AS section, string_agg(CASE WHEN NOT h THEN l END, chr(10) ORDER BY pos) AS body,
row_number() OVER (PARTITION BY doc_id ORDER BY s) AS section_no FROM g GROUP BY doc_id, s HAVING count(CASE WHEN NOT h THEN 1 END) > 0)"""


Q_SECTIONS = q_sections(Q_LINES)


@_query(f"WITH {Q_SECTIONS} SELECT doc_id, section_no, section, body FROM sec")
def sections(spark, sf):
    d = _headed(_t(spark, sf, "documents"))
    return chunking.sections(d, "doc_id", "text").select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section", "body")


def q_windows(src, key, body):
    words = rf"list_filter(string_split_regex({body}, '\s+'), lambda x: x <> '')"
    return f"""w AS (SELECT {key}, {body} AS body, {words} AS ws FROM {src}),
p AS (SELECT {key}, body, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 220 THEN [0] ELSE range(0, CAST(ceil((len(ws) - 220) / 180.0) AS BIGINT) * 180 + 1, 180) END) AS s FROM w),
win AS (SELECT {key}, s, s // 180 + 1 AS part, CASE WHEN len(ws) <= 220 THEN body ELSE array_to_string(ws[s + 1 : s + 220], ' ') END AS piece FROM p)"""


@_query(f"WITH {q_windows('documents', 'doc_id', 'text')} SELECT doc_id, CAST(part AS BIGINT) AS part, piece FROM win")
def word_windows(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(chunking.word_windows("text")).alias("part", "piece"))
    return d.select("doc_id", (F.col("part") + 1).cast("long").alias("part"), "piece")


def _elements(docs: DataFrame) -> DataFrame:
    """Documents as extracted elements: the id, from 1, is the place in the file; a seventh of them are paged, a fifth are tables."""
    return _headed(docs).select(
        F.format_string("D%d", "doc_id").alias("doc_id"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Doc "), "source")).alias("title"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Bagian "), "lang")).alias("section"),
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 11).cast("int").alias("page"),
        F.when(F.col("doc_id") % 5 == 0, "table").alias("chunk_type"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/")).alias("source_url"),
        "text",
        (F.col("doc_id") + 1).alias("doc_ord"),
    )


Q_NORM = "substr(upper(trim(regexp_replace(section, '[^A-Za-z0-9]+', '_', 'g'), '_')), 1, 48)"


@_query(f"""WITH {Q_SECTIONS},
e AS (SELECT doc_id AS k, concat('D', doc_id) AS did, CASE WHEN doc_id % 3 > 0 THEN concat('Doc ', source) END AS title, CASE WHEN doc_id % 4 = 0 THEN concat('Bagian ', lang) END AS own,
CASE WHEN doc_id % 7 = 0 THEN doc_id % 11 END AS page, CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS ctype, {HEADED} AS text FROM documents),
b AS (SELECT *, coalesce(own, CASE WHEN page <> 0 THEN concat('page_', page) END, 'General') AS base FROM e),
f AS (SELECT b.*, 1 AS sno, coalesce(own, base) AS found, text AS sbody FROM b WHERE ctype = 'table' OR own IS NOT NULL
UNION ALL SELECT b.*, s.section_no, s.section, s.body FROM b JOIN sec s ON s.doc_id = b.k WHERE NOT (ctype = 'table' OR own IS NOT NULL)),
x AS (SELECT *, CASE WHEN found = 'General' THEN base ELSE found END AS section, CASE WHEN found <> 'General' THEN found END AS subtitle, row_number() OVER (ORDER BY k, sno) AS rid FROM f),
{q_windows('x', 'rid', 'sbody')}
SELECT CASE WHEN own IS NOT NULL AND page IS NULL AND part = 1 THEN concat(did, '_', {Q_NORM}, '_', lpad(CAST(k + 1 AS VARCHAR), CAST(greatest(3, length(CAST(k + 1 AS VARCHAR))) AS INTEGER), '0'))
ELSE concat(did, '_', {Q_NORM}, '_', lpad(CAST(k + 1 AS VARCHAR), CAST(greatest(4, length(CAST(k + 1 AS VARCHAR))) AS INTEGER), '0'), '_', lpad(CAST(part AS VARCHAR), CAST(greatest(2, length(CAST(part AS VARCHAR))) AS INTEGER), '0')) END AS chunk_id,
section, array_to_string(list_filter([coalesce(title, did), section, subtitle], lambda v: v IS NOT NULL), ' > ') AS path, coalesce(title, did) AS source, ctype AS chunk_type,
len(regexp_extract_all(piece, '[\\p{{L}}\\p{{N}}_]+')) AS n_tokens, md5(piece) AS digest FROM x JOIN win USING (rid)""".replace("\\\\p", "\\p"))
def chunks(spark, sf):
    c = chunking.build_chunks(_elements(_t(spark, sf, "documents")))
    return c.select("chunk_id", "section", F.array_join("hierarchy_path", " > ").alias("path"), "source", "chunk_type", F.col("token_count_approx").cast("long").alias("n_tokens"), F.md5("text").alias("digest"))


# --- retrieval -------------------------------------------------------------------------
Q_TERMS = f"""t AS MATERIALIZED (SELECT doc_id, {q_retrieval('text')} AS tk FROM documents),
tot AS MATERIALIZED (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM t),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM t) GROUP BY ALL EXCLUDE (dl) ),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, tot),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)""".replace("GROUP BY ALL EXCLUDE (dl) ", "GROUP BY doc_id, term")


@_query(f"WITH {Q_TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_stats(spark, sf):
    terms, _ = retrieval.bm25_stats(_t(spark, sf, "documents"), tx.tokenize_retrieval("text"))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


Q_BM25 = f"""{Q_TERMS},
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({q_retrieval('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s FROM qt JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS bm25_rank FROM sc)"""


def _bm25(spark, sf, k):
    """The documents' index is built and kept in the shared folder; the search reads it alone."""
    toks = tx.tokenize_retrieval("text")
    index = inverted.build_inverted(_t(spark, sf, "documents"), "doc_id", toks, io.new_folder(spark, "index"))
    return index.search(_t(spark, sf, "benchmark"), "item_id", toks, k)


@_query(f"WITH {Q_BM25} SELECT item_id, doc_id AS doc, round(s, 6) AS bm25_score, bm25_rank FROM bm WHERE bm25_rank <= 4 AND s > 0")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 4).select("item_id", "doc", F.round("bm25_score", 6).alias("bm25_score"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


@_query(f"""WITH q AS (SELECT item_id, list_distinct({q_retrieval('text', lx.DEMO_STOPWORDS)}) AS t FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({q_retrieval('text', lx.DEMO_STOPWORDS)})) AS term FROM documents),
s AS (SELECT item_id, doc_id, round(count(*) / greatest(1, any_value(n)), 9) AS score FROM (SELECT item_id, len(t) AS n, unnest(t) AS term FROM q) JOIN d USING (term) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id AS doc, round(score, 6) AS score, rank FROM r WHERE rank <= 4""")
def overlap_topk(spark, sf):
    toks = tx.tokenize_demo("text")
    got = retrieval.overlap_search(_t(spark, sf, "benchmark"), "item_id", toks, _t(spark, sf, "documents"), "doc_id", toks)
    return got.select("item_id", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# search queries are every row whose id is divisible by 20, against all rows
Q_VEC = """vs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS vector_rank FROM vs)"""


def _vectors(spark, sf, k):
    e = _t(spark, sf, "embeddings")
    return retrieval.semantic_search(e.where("vec_id % 20 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", k).withColumnRenamed("vec_id", "query_id")


@_query(f"WITH {Q_VEC} SELECT query_id, doc, round(s, 6) AS semantic_score, vector_rank FROM vr WHERE vector_rank <= 5")
def vector_topk(spark, sf):
    return _vectors(spark, sf, 5).select("query_id", "doc", F.round("semantic_score", 6).alias("semantic_score"), F.col("vector_rank").cast("long").alias("vector_rank"))


Q_SIDE = """lex AS (SELECT vec_id AS doc, CAST(q AS BIGINT) AS query_id, row_number() OVER (PARTITION BY q ORDER BY abs(vec_id - q), vec_id) AS bm25_rank
FROM embeddings, (SELECT vec_id AS q FROM embeddings WHERE vec_id % 20 = 0) WHERE abs(vec_id - q) <= 9 QUALIFY bm25_rank <= 8)"""


def _nearby(spark, sf) -> DataFrame:
    """A second rank list for the vectors: nearest ids."""
    near = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc")).withColumn("query_id", F.explode(F.array(*[F.floor(F.col("doc") / 20) * 20 + s for s in (0, 20)])))
    near = near.where("abs(doc - query_id) <= 9").join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.abs(F.col("doc") - F.col("query_id")), "doc")
    return near.withColumn("bm25_rank", F.row_number().over(w)).where("bm25_rank <= 8")


@_query(f"""WITH {Q_VEC}, {Q_SIDE}, u AS (SELECT query_id, doc, vector_rank AS r FROM vr WHERE vector_rank <= 20 UNION ALL SELECT query_id, doc, bm25_rank FROM lex)
SELECT query_id, doc, round(sum(1.0 / (60 + r)), 6) AS rrf_score FROM u GROUP BY ALL""")
def rrf_fuse(spark, sf):
    lists = [_vectors(spark, sf, 20).withColumnRenamed("vector_rank", "rank"), _nearby(spark, sf).withColumnRenamed("bm25_rank", "rank")]
    return retrieval.rank_fusion(lists, ["query_id", "doc"]).withColumn("rrf_score", F.round("rrf_score", 6))


@_query(f"""WITH {Q_VEC}, {Q_SIDE}, v AS (SELECT * FROM vr WHERE vector_rank <= 20),
f AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.doc, l.doc) AS doc, l.bm25_rank, v.vector_rank, coalesce(1.0 / (60 + l.bm25_rank), 0) + coalesce(1.0 / (60 + v.vector_rank), 0) AS s
FROM lex l FULL OUTER JOIN v ON l.query_id = v.query_id AND l.doc = v.doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, bm25_rank ASC NULLS LAST, vector_rank ASC NULLS FIRST, doc) AS position FROM f WHERE doc % 2 = 0)
SELECT query_id, doc, bm25_rank, vector_rank, round(s, 6) AS rrf_score, position FROM r WHERE position <= 4""")
def hybrid_filtered(spark, sf):
    kinds = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.when(F.col("vec_id") % 2 == 0, "table").otherwise("text").alias("chunk_type"))
    got = retrieval.hybrid_retrieve(_nearby(spark, sf), _vectors(spark, sf, 20), kinds, "query_id", 4, ["table"])
    return got.select("query_id", "doc", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), "rrf_score", F.col("position").cast("long").alias("position"))


# the whole chain: expanded questions, BM25 over search texts and dense search, fused, filtered by type
Q_SEARCHED = "concat_ws(' ', source, lang, text, text)"
Q_CHAIN = Q_BM25.replace(q_retrieval("text"), q_retrieval(Q_SEARCHED), 1).replace(q_retrieval("text"), q_retrieval(Q_EXPANDED))


@_query(f"""WITH {Q_CHAIN}, l AS (SELECT item_id, doc_id AS doc, bm25_rank FROM bm WHERE bm25_rank <= 20 AND s > 0),
vs AS (SELECT q.vec_id AS item_id, d.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
v AS (SELECT item_id, doc, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc) AS vector_rank FROM vs QUALIFY vector_rank <= 20),
f AS (SELECT coalesce(v.item_id, l.item_id) AS item_id, coalesce(v.doc, l.doc) AS doc, l.bm25_rank, v.vector_rank, coalesce(1.0 / (60 + l.bm25_rank), 0) + coalesce(1.0 / (60 + v.vector_rank), 0) AS s
FROM l FULL OUTER JOIN v ON l.item_id = v.item_id AND l.doc = v.doc),
r AS (SELECT f.*, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, bm25_rank ASC NULLS LAST, vector_rank ASC NULLS FIRST, doc) AS position FROM f JOIN documents ON doc_id = doc WHERE doc_id % 5 <> 0)
SELECT item_id, doc, bm25_rank, vector_rank, round(s, 6) AS rrf_score, position FROM r WHERE position <= 4""")
def hybrid_chain(spark, sf):
    docs, items, vecs = (_t(spark, sf, n) for n in ("documents", "benchmark", "embeddings"))
    asked = items.withColumn("text", F.expr(ASKED)).select("item_id", tx.expand_query("text").alias("query"))
    none = F.lit(None).cast("string")
    listed = retrieval.bm25_search(asked, "item_id", tx.tokenize_retrieval("query"), docs, "doc_id", tx.tokenize_retrieval(tx.search_text("source", "lang", none, none, "text", "text")), 20)
    near = retrieval.semantic_search(vecs.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", vecs, "vec_id", "embedding", 20)
    kinds = docs.select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("chunk_type"))
    got = retrieval.hybrid_retrieve(listed, near.withColumnRenamed("vec_id", "item_id"), kinds, "item_id", 4, ["text"])
    return got.select("item_id", "doc", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), "rrf_score", F.col("position").cast("long").alias("position"))


Q_CLEAN_LINES = r"""l AS (SELECT doc_id // 4 AS query_id, doc_id % 4 AS position, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r]') AS ls FROM documents)),
c AS (SELECT query_id, position, n, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(line) ORDER BY position, n) AS rn FROM c WHERE length(line) >= 3 AND NOT regexp_matches(line, '^[^\p{L}\p{N}]+$')),
t AS (SELECT query_id, position, string_agg(line, chr(10) ORDER BY n) AS text FROM k WHERE rn = 1 GROUP BY query_id, position)"""


@_query(rf"""WITH RECURSIVE {Q_CLEAN_LINES},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS i FROM t),
r AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS chars, false AS done, CAST(NULL AS BIGINT) AS position, '' AS cut FROM (SELECT DISTINCT query_id FROM o)
UNION ALL SELECT query_id, i, CASE WHEN done THEN used ELSE used + len(regexp_extract_all(cut, '[\p{{L}}\p{{N}}_]+')) END, CASE WHEN done THEN chars ELSE chars + length(cut) END, done, CASE WHEN NOT done THEN position END, cut
FROM (SELECT o.query_id, o.i, o.position, r.used, r.chars, r.done OR r.used >= 300 OR r.chars >= 1500 AS done,
  substr(CASE WHEN len(ws) > 300 - r.used THEN array_to_string(ws[1 : greatest(300 - r.used, 0)], ' ') ELSE o.text END, 1, greatest(1500 - r.chars, 0)) AS cut
  FROM r JOIN (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM o) o ON o.query_id = r.query_id AND o.i = r.i + 1))
SELECT query_id, position, cut AS text FROM r WHERE position IS NOT NULL""")
def prune_context(spark, sf):
    d = _t(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("query_id"), (F.col("doc_id") % 4).alias("position"), "text")
    return retrieval.prune_context(d, "query_id", "position", "text", 300)


@_query(f"WITH {Q_CLEAN_LINES} SELECT query_id, position, text FROM t")
def prune_dedup(spark, sf):
    d = _t(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("query_id"), (F.col("doc_id") % 4).alias("position"), "text")
    return retrieval.prune_context(d, "query_id", "position", "text", 1 << 28, 1 << 30)


@_query("""SELECT a.doc_id, b.vec_id, a.n AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) AS n FROM documents) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS n FROM embeddings) b USING (n)""")
def positional_zip(spark, sf):
    """The n-th document by text with the n-th vector by label."""
    d = ordering.numbered(_t(spark, sf, "documents").select("doc_id", "text"), ["text", "doc_id"], "n")
    e = ordering.numbered(_t(spark, sf, "embeddings").select("vec_id", "label"), ["label", "vec_id"], "n")
    return d.join(e, "n").select("doc_id", "vec_id", (F.col("n") + 1).alias("place"))


# --- evaluation ------------------------------------------------------------------------
def _asked(spark, sf) -> DataFrame:
    """(conv_id, turn, question, answer): each user's turn with the assistant's next one."""
    c = _t(spark, sf, "conversations").withColumn("text", F.expr(SAID))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return q.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])


def _contexts(docs: DataFrame) -> DataFrame:
    """Documents as contexts, with their doc_id: whole texts, a third of them from an official host."""
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.lit("").alias("subsection"), F.lit("").alias("subtitle"),
        "text", F.lit("").alias("content"), F.when(F.col("doc_id") % 3 == 0, "https://a.example.org/x").otherwise("https://example.com/").alias("source_url"), F.array("source").alias("hierarchy_path"),
    )


def _cases(spark, sf) -> DataFrame:
    """Every document is a context of the cases of one conversation: its number modulo their count."""
    convs = _t(spark, sf, "conversations").agg((F.max("conv_id") + 1).alias("convs"))
    c = _contexts(_t(spark, sf, "documents"))
    fields = [x for x in c.columns if x != "doc_id"]
    dealt = c.join(F.broadcast(convs), F.lit(True)).groupBy((F.col("doc_id") % F.col("convs")).alias("conv_id"))
    lists = dealt.agg(F.array_sort(F.collect_list(F.struct("doc_id", F.struct(*fields).alias("c")))).alias("s"))
    return _asked(spark, sf).join(lists.select("conv_id", F.transform("s", lambda x: x["c"]).alias("contexts")), "conv_id")


Q_ASKED = f"""cv AS (SELECT conv_id, turn, role, {SAID} AS text FROM conversations),
cs AS (SELECT q.conv_id, q.turn, concat(q.conv_id, '-', q.turn) AS k, q.text AS question, a.text AS answer FROM cv q JOIN cv a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""
Q_DEALT = "cx AS (SELECT k, doc_id AS pos, doc_id, source, lang, text AS dtext FROM cs JOIN documents ON doc_id % (SELECT max(conv_id) + 1 FROM conversations) = conv_id)"
# letters beyond ASCII count as word characters on both sides
Q_ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', 'x', 'g')"


def q_count(c, pattern):
    return f"len(regexp_extract_all({Q_ASCII.format(c)}, '{pattern}'))"


def q_contains(c, marks):
    return "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in marks) + ")"


Q_NEUTRAL = "(contains(pl, 'informasi lebih lanjut') AND (contains(pl, 'situs resmi') OR contains(pl, 'layanan pelanggan') OR contains(pl, 'hubungi')))"
Q_NO_ANSWER = (
    "(contains(pl, 'tidak tersedia dalam konteks') OR contains(pl, 'tidak tersedia dalam dokumen') OR contains(pl, 'tidak tercantum dalam cuplikan') "
    "OR contains(pl, 'tidak tersedia') AND contains(pl, 'konteks resmi') OR contains(pl, 'konteks resmi yang tersedia') AND contains(pl, 'tidak'))"
)
Q_PL = "regexp_replace(lower({}), '[*_`]+', '', 'g')"


def q_lexical():
    """Supports of the claims of ``cs`` by the contexts ``cx``, one by one and together."""
    text = "concat_ws(' ', source, lang, '', dtext, '')"
    return f"""tk AS MATERIALIZED (SELECT k, pos, doc_id, {text} AS body, {q_evidence(text)} AS ev, {q_numbers(text)} AS en, len({q_evidence('dtext')}) AS nt FROM cx),
al AS (SELECT k, string_agg(body, ' ' ORDER BY pos) AS body, list_distinct(flatten(list(ev))) AS ev FROM tk GROUP BY k),
e AS (SELECT k, list_distinct(ev) AS ev, en FROM tk UNION ALL SELECT k, ev, {q_numbers('body')} FROM al),
cl AS (SELECT k, unnest({q_claims('answer')}) AS c, generate_subscripts({q_claims('answer')}, 1) AS cid FROM cs),
w AS (SELECT k, cid, list_distinct({q_evidence('c')}) AS w, {q_numbers('c')} AS n FROM (SELECT *, {Q_PL.format('c')} AS pl FROM cl) WHERE NOT {Q_NEUTRAL}),
s AS (SELECT k, cid, least(1.0, max(CASE WHEN len(w) = 0 THEN 1.0 WHEN e.ev IS NULL OR len(e.ev) = 0 THEN 0.0
  ELSE len(list_intersect(w, e.ev)) / greatest(1, len(w)) * CASE WHEN len(list_filter(n, lambda x: NOT list_contains(e.en, x))) > 0 THEN 0.35 ELSE 1.0 END END)) AS s FROM w LEFT JOIN e USING (k) GROUP BY k, cid),
g AS (SELECT k, avg(s) AS m, sum(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) AS ok, count(*) AS n FROM s GROUP BY k),
lex AS (SELECT k, coalesce(round(round((0.72 * m + 0.28 * ok / n) * CASE WHEN ok / n < 0.5 THEN greatest(0.25, ok / n) ELSE 1 END, 9), 3), 0.0) AS lexical_score,
  CAST(coalesce(ok, 0) AS BIGINT) AS supported_claims, coalesce(n, 0) AS total_claims FROM cs LEFT JOIN g USING (k))"""


def q_quality(official):
    return f"""cq AS (SELECT k, count(x.doc_id) AS nc, avg(CASE WHEN {official} THEN 1.0 ELSE 0.0 END) AS o, max(len(list_intersect(qt, x.ev)) / greatest(1, len(qt))) AS r, least(sum(x.nt) / 90.0, 1.0) AS n,
  string_agg(CASE WHEN NOT ({official}) THEN concat('non_official_context:', doc_id) END, '|' ORDER BY pos) AS bad FROM (SELECT k, list_distinct({q_evidence('question')}) AS qt FROM cs) LEFT JOIN tk x USING (k) GROUP BY k),
cqs AS (SELECT k, CASE WHEN nc > 0 THEN round(0.5 * o + 0.3 * r + 0.2 * n, 3) ELSE 0.0 END AS context_quality_score, CASE WHEN nc > 0 THEN coalesce(bad, '') ELSE 'no_retrieved_context' END AS warnings FROM cq)"""


def q_specificity(attribution):
    a, share = Q_ASCII.format("answer"), "least({} / {}, 1.0)"
    steps = f"len(regexp_extract_all({a}, '(?m)^\\s*\\d+[.)]')) + {q_count('lower(answer)', lx.ACTIONS)}"
    return rf"""sa AS (SELECT cs.k, {attribution} AS attr, {q_evidence('answer')} AS toks, list_distinct({q_evidence('question')}) AS asked, {steps} AS steps, {q_count('answer', '(?i)' + lx.DETAILS)} AS details, {q_any('answer', lx.UNSAFE_CLAIMS)} AS unsafe
  FROM cs LEFT JOIN lex USING (k)),
sb AS (SELECT *, len(list_intersect(asked, toks)) / greatest(1, len(asked)) AS overlap FROM sa),
sc AS (SELECT *, 0.20 * {share.format('len(toks)', '60.0')} + 0.25 * {share.format('steps', '4.0')} + 0.35 * overlap + 0.20 * {share.format('details', '4.0')} AS v FROM sb),
sd AS (SELECT *, CASE WHEN (overlap >= 0.55 AND steps >= 1 AND details >= 1) OR (attr >= 0.80 AND overlap >= 0.45) OR (details >= 1 AND overlap >= 0.35) THEN greatest(v, 0.52) ELSE v END AS v2 FROM sc),
spec AS (SELECT k, CASE WHEN len(toks) = 0 THEN 0.0 ELSE round(greatest(0.0, least(CASE WHEN attr < 0.5 AND (steps >= 2 OR unsafe) THEN v2 * 0.45 ELSE v2 END, 1.0)), 3) END AS specificity_score FROM sd)"""


def q_evaluated(official):
    """The scores and routes of ``cs`` with contexts ``cx``, without semantic scores."""
    t = lx.THRESHOLDS
    fails = f"""list_filter([CASE WHEN {q_any('answer', lx.EXPLICIT_CLAIMS)} THEN 'explicit_clinical_claim' END, CASE WHEN asks AND NOT refused THEN 'individual_medical_advice_not_refused' END,
  CASE WHEN asks AND refused THEN 'individual_medical_advice_request' END, CASE WHEN attribution_score < {t['review_a']} AND specificity_score >= {t['accept_s']} AND total_claims > 0 AND NOT {Q_NO_ANSWER} THEN 'low_attribution_specific_answer' END,
  CASE WHEN contains(warnings, 'non_official_context') THEN 'non_official_context' END, CASE WHEN {q_any('answer', lx.UNSAFE_CLAIMS)} AND NOT refused THEN 'unsafe_actionable_medical_claim' END], lambda x: x IS NOT NULL)"""
    return f"""{q_lexical()},
{q_quality(official)},
{q_specificity('round(0.4 * lexical_score, 3)')},
al2 AS (SELECT cs.*, lexical_score, supported_claims, total_claims, round(0.4 * lexical_score, 3) AS attribution_score, specificity_score, context_quality_score, warnings,
  {q_any('question', lx.MEDICAL_ADVICE)} AS asks, {q_contains('answer', lx.REFUSALS)} AS refused, {Q_PL.format('answer')} AS pl FROM cs JOIN lex USING (k) JOIN cqs USING (k) JOIN spec USING (k)),
evaluated AS (SELECT *, array_to_string(fails, '|') AS hard_fails, CASE WHEN len(fails) > 0 THEN 'REJECT' WHEN attribution_score >= {t['accept_a']} AND specificity_score >= {t['accept_s']} AND context_quality_score >= {t['accept_c']} THEN 'ACCEPT'
  WHEN (attribution_score >= {t['review_a']} AND context_quality_score >= {t['review_c']}) OR context_quality_score >= {t['accept_c']} THEN 'REVIEW' ELSE 'REJECT' END AS route FROM (SELECT *, {fails} AS fails FROM al2))"""


@_query(f"WITH {Q_ASKED}, {Q_DEALT}, {q_lexical()} SELECT conv_id, turn, lexical_score, supported_claims, total_claims FROM lex JOIN cs USING (k)")
def lexical_attribution(spark, sf):
    got = _cases(spark, sf).select("conv_id", "turn", scoring.lexical_attribution(scoring.claim_supports("answer", F.col("contexts"))).alias("l"))
    return got.select("conv_id", "turn", "l.lexical_score", F.col("l.supported_claims").cast("long").alias("supported_claims"), F.col("l.total_claims").cast("long").alias("total_claims"))


@_query(f"WITH {Q_ASKED}, {Q_DEALT}, {q_lexical()}, {q_quality('doc_id % 3 = 0')} SELECT conv_id, turn, context_quality_score, warnings FROM cqs JOIN cs USING (k)")
def context_quality(spark, sf):
    got = _cases(spark, sf).select("conv_id", "turn", scoring.context_quality("question", F.col("contexts"), ["example.org"]).alias("c"))
    return got.select("conv_id", "turn", "c.context_quality_score", F.array_join("c.warnings", "|").alias("warnings"))


@_query(f"WITH {Q_ASKED}, lex AS (SELECT k FROM cs), {q_specificity('0.6')} SELECT conv_id, turn, specificity_score FROM spec JOIN cs USING (k)")
def specificity(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", scoring.specificity("question", "answer", F.lit(0.6)).alias("specificity_score"))


@_query(f"WITH {Q_ASKED}, {Q_DEALT}, {q_evaluated('doc_id % 3 = 0')} SELECT conv_id, turn, route, attribution_score, specificity_score, context_quality_score, lexical_score, hard_fails, warnings FROM evaluated")
def evaluate_cases(spark, sf):
    got = scoring.evaluate(_cases(spark, sf), domains=["example.org"])
    return got.select("conv_id", "turn", "route", "attribution_score", "specificity_score", "context_quality_score", "lexical_score", F.array_join("hard_fails", "|").alias("hard_fails"), F.array_join("warnings", "|").alias("warnings"))


Q_PAIRS = "e AS (SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS s, (a.vec_id % 11) / 10.0 AS l FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    s = F.round(scoring.semantic_score(F.col("embedding"), F.array("other")), 6)
    return e.join(b, "vec_id").select("vec_id", s.alias("s"), ((F.col("vec_id") % 11) / 10.0).alias("l"))


@_query(f"WITH {Q_PAIRS} SELECT vec_id, s AS semantic_score, round(0.6 * s + 0.4 * l, 3) AS attribution_score FROM e")
def hybrid_attribution(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.col("s").alias("semantic_score"), scoring.blend(F.col("s"), F.col("l")).alias("attribution_score"))


@_query("""WITH c AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 4)
SELECT vec_id AS case_id, round(greatest(0.0, least(1.0, max(s))), 6) AS semantic_score FROM c GROUP BY vec_id""")
def semantic_cases(spark, sf):
    """Each vector as an answer, the four after it as those of its contexts."""
    e = _t(spark, sf, "embeddings")
    ids = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct((F.col("vec_id") + i).cast("string").alias("chunk_id")))
    answered = e.select(F.col("vec_id").alias("case_id"), F.col("vec_id").cast("string").alias("answer"), ids.alias("contexts"), "embedding")
    vectors = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    held = answered.join(vectors.select((F.col("chunk_id").cast("long") - 1).alias("case_id")), "case_id", "left_semi")
    got = scoring.semantic_scores(held, "case_id", lambda text: F.col("embedding"), vectors)
    return got.select("case_id", F.round("semantic_score", 6).alias("semantic_score"))


@_query("""SELECT doc_id, CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'REJECT' WHEN a >= 0.78 AND s >= 0.5 AND c >= 0.7 THEN 'ACCEPT' WHEN (a >= 0.45 AND c >= 0.45) OR c >= 0.7 THEN 'REVIEW' ELSE 'REJECT' END AS route
FROM (SELECT doc_id, toxic, (doc_id % 101) / 100.0 AS a, (doc_id % 89) / 88.0 AS s, (doc_id % 53) / 52.0 AS c FROM labels)""")
def decide_routes(spark, sf):
    return _labelled(spark, sf).select("doc_id", "route")


def _labelled(spark, sf) -> DataFrame:
    lab = _t(spark, sf, "labels")
    a, s, c = (F.col("doc_id") % 101) / 100.0, (F.col("doc_id") % 89) / 88.0, (F.col("doc_id") % 53) / 52.0
    fails = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    out = lab.select("doc_id", scoring.decide_route(fails, a, s, c).alias("route"), F.when(F.col("quality") == 1, "ACCEPT").otherwise("REJECT").alias("expected_route"), a.alias("attribution_score"), s.alias("specificity_score"), c.alias("context_quality_score"))
    return scoring.with_pass(out)


@_query(f"""WITH r AS (SELECT l.doc_id, x.route, CASE WHEN quality = 1 THEN 'ACCEPT' ELSE 'REJECT' END AS expected, (l.doc_id % 101) / 100.0 AS a FROM labels l JOIN ({_SQL['decide_routes']}) x USING (doc_id))
SELECT count(*) AS total_cases, count(*) FILTER (route = expected) AS passed_cases, round(count(*) FILTER (route = expected) / count(*), 3) AS pass_rate, count(*) FILTER (route = 'ACCEPT') AS accepted,
round(avg(a), 3) AS attribution, count(*) FILTER (route <> expected) AS failed FROM r""")
def quality_summary(spark, sf):
    s = reporting.quality_summary(_labelled(spark, sf), "doc_id", "doc_id")
    return s.select("total_cases", "passed_cases", "pass_rate", F.coalesce(F.try_element_at("route_counts", F.lit("ACCEPT")), F.lit(0)).alias("accepted"), F.col("metric_averages")["attribution_score"].alias("attribution"), F.size("failed_question_ids").cast("long").alias("failed"))


@_query("SELECT doc_id, substr(text, 1, 500) AS preview FROM documents")
def debug_preview(spark, sf):
    d = _t(spark, sf, "documents")
    ctx = F.array(F.struct(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.lit(0.0).alias("rrf_score"), F.lit(1).alias("bm25_rank"), F.lit(1).alias("vector_rank"), "text", F.lit("").alias("content")))
    return d.select("doc_id", F.get(reporting.context_preview(ctx), F.lit(0))["text_preview"].alias("preview"))


@_query("""SELECT doc_id AS question_id, CASE WHEN doc_id % 3 = 0 AND quality = 0 THEN 'question|invalid expected_route' WHEN doc_id % 3 = 0 THEN 'question' ELSE 'invalid expected_route' END AS problems FROM labels WHERE doc_id % 3 = 0 OR quality = 0""")
def evalset_violations(spark, sf):
    cases = _t(spark, sf, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 != 0, "q").alias("question"), F.when(F.col("quality") == 1, "ACCEPT").otherwise("SKIP").alias("expected_route"))
    return reporting.evalset_violations(cases, ["question_id", "question", "expected_route"]).select("question_id", F.array_join("problems", "|").alias("problems"))


@_query("""SELECT conv_id, CAST(x AS BIGINT) AS chunk_id FROM (SELECT DISTINCT conv_id, unnest([conv_id, conv_id * 20]) AS x FROM conversations) WHERE x NOT IN (SELECT doc_id FROM documents)""")
def dangling_context_ids(spark, sf):
    cases = _t(spark, sf, "conversations").select("conv_id").distinct().withColumn("ids", F.array_distinct(F.array(F.col("conv_id"), F.col("conv_id") * 20)))
    return reporting.dangling_ids(cases, "conv_id", "ids", _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")))


# --- prompts ---------------------------------------------------------------------------
Q_BLOCK = "concat('[', concat_ws(' > ', source, CASE WHEN doc_id % 2 = 0 THEN lang END), ']', chr(10), CASE WHEN doc_id % 5 = 0 THEN concat('Tabel Referensi:', chr(10)) ELSE '' END, text)"


def _prompt_context(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("query_id"), (F.col("doc_id") % 4).alias("position"), "doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("sec"), "text")
    crumb = generation.breadcrumb(F.lit(None).cast("array<string>"), F.col("source"), F.col("sec"), F.lit(None).cast("string"))
    return generation.joined_context(d, "query_id", "position", generation.context_block(crumb, F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text"), F.col("text")))


@_query(f"SELECT doc_id // 4 AS query_id, string_agg({Q_BLOCK}, chr(10) || chr(10) ORDER BY doc_id) AS context FROM documents GROUP BY 1")
def breadcrumbs(spark, sf):
    return _prompt_context(spark, sf)


@_query(f"""SELECT item_id, 'system' AS role0, concat('Jawab.', chr(10), chr(10), 'Konteks Resmi:', chr(10), context) AS content0, text AS content1
FROM benchmark JOIN (SELECT doc_id // 4 AS query_id, string_agg({Q_BLOCK}, chr(10) || chr(10) ORDER BY doc_id) AS context FROM documents GROUP BY 1) ON query_id = item_id""")
def chat_messages(spark, sf):
    j = _t(spark, sf, "benchmark").join(_prompt_context(spark, sf), F.col("item_id") == F.col("query_id"))
    m = j.select("item_id", generation.messages("text", "context", "Jawab.").alias("m"))
    return m.select("item_id", F.col("m")[0]["role"].alias("role0"), F.col("m")[0]["content"].alias("content0"), F.col("m")[1]["content"].alias("content1"))


RAW = """CASE conv_id % 4 WHEN 0 THEN concat('{"exact_quote": "q', conv_id, '", "final_answer": "a', turn, '"}') WHEN 1 THEN concat('plain ', conv_id) WHEN 2 THEN concat('{"final_answer":"x', turn, '"} trailing') ELSE concat('{"exact_quote":"only', turn, '"}') END"""


@_query(f"""SELECT conv_id, turn, CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(raw, '$.exact_quote'), '') ELSE '' END AS exact_quote,
CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(raw, '$.final_answer'), raw) ELSE raw END AS final_answer FROM (SELECT conv_id, turn, {RAW} AS raw FROM conversations)""")
def answer_json(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("raw", F.expr(RAW)).select("conv_id", "turn", generation.answer_json("raw").alias("a"))
    return c.select("conv_id", "turn", "a.exact_quote", "a.final_answer")


# --- tables ----------------------------------------------------------------------------
def _cells(spark, sf) -> DataFrame:
    """A table from each order: a header row, a rule, two data rows of which one is short."""
    o = _t(spark, sf, "orders")
    s = lambda c: F.col(c).cast("string")
    rows = F.array(
        F.array(F.lit("Order"), F.lit("Status"), F.lit(" ")),
        F.array(F.lit("---"), F.lit("|"), F.lit("-")),
        F.array(s("o_orderkey"), F.concat(s("o_orderstatus"), F.lit("|x")), F.lit("-")),
        F.array(F.lit("total"), s("o_custkey")),
    )
    return o.select("o_orderkey", rows.alias("cells"))


@_query("""SELECT o_orderkey, concat('| Order | Status | col_3 |', chr(10), '| --- | --- | --- |', chr(10), '| ', o_orderkey, ' | ', o_orderstatus, '\\|x | - |', chr(10), '| total | ', o_custkey, ' |  |') AS markdown FROM orders""".replace("\\\\", "\\"))
def table_markdown(spark, sf):
    return _cells(spark, sf).select("o_orderkey", tables.table_to_markdown("cells").alias("markdown"))


@_query("SELECT o_orderkey, concat('Baris 1: Order: ', o_orderkey, ' | Status: ', o_orderstatus, '|x', chr(10), 'Baris 2: Order: total | Status: ', o_custkey) AS kv FROM orders")
def table_kv(spark, sf):
    return _cells(spark, sf).select("o_orderkey", tables.table_to_text("cells").alias("kv"))


@_query(r"""SELECT doc, table_index, content FROM (SELECT *, row_number() OVER (PARTITION BY doc, regexp_replace(lower(content), '\s+', ' ', 'g') ORDER BY table_index) AS n
FROM (SELECT o_custkey AS doc, o_orderkey AS table_index, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) || '  x' ELSE lower(o_orderstatus) || ' X' END AS content FROM orders)) WHERE n = 1""")
def table_dedup(spark, sf):
    t = _t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("table_index"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) || '  x' ELSE lower(o_orderstatus) || ' X' END").alias("content"))
    return tables.dedup_tables(t, ["doc"])
