"""The queries of the training-data operators: thin projections of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chat import NAME_CODES, render_dialogues, rotate_perspectives
from quire.llm.decontam import contaminated_passages
from quire.llm.embeddings import embedding_groups
from quire.llm.htmltext import extract_pages
from quire.llm.langid import fit_languages, identify_language
from quire.llm.licenses import COMMENT, CUES, DECLARED, EXCEPTION, IDENTIFIER, NEGATED, OPERATOR, OTHER, TEMPLATES, VERSIONS, scan_licenses, template_terms
from quire.llm.mixing import WORDS, mix_sources
from quire.llm.quality import fit_quality, score_quality
from quire.llm.sharding import shard_documents
from quire.llm.simhash import simhash_groups
from quire.llm.substring import dedup_substrings
from quire.llm.vector_codes import compress_vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(docs)))
    out = identify_language(docs.select("doc_id", "text", held_out(docs).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_form():
    """The topic that the documents are raked by: they have none, so a coarse form of the text stands for it."""
    t = F.col("text")
    marks = F.length(t) - F.length(F.translate(t, "#$%&*!", ""))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (
        F.when(F.coalesce(F.length(t), F.lit(0)) == 0, "empty")
        .when(marks * 20 >= F.length(t), "symbols")
        .when(breaks >= 8, "sections")
        .when(F.length(t) < 400, "notes")
        .otherwise("prose")
    )


def mixture(docs: DataFrame, keep: list[str] | None = None, prefix: str = "__") -> DataFrame:
    """The mix of the corpus: each marginal's target is its natural tokens to the power of 0.5."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": text_form()}
    return mix_sources(docs, dims, temperature=0.5, fraction=0.5, keep=keep, prefix=prefix)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.col("__source").alias("source"),
        F.col("__lang").alias("lang"),
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"),
        F.round("__probability", 6).alias("probability"),
        F.col("__sampled").alias("sampled"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as files /source/lang/block/id; a short one with a licence cue stands for a
    LICENSE file of its block, language or source directory, by its id."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    dirs = [F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string")]
    is_license = F.coalesce(F.col("text").rlike(CUES) & (F.regexp_count("text", F.lit(WORDS)) <= 40), F.lit(False))
    level = F.col("doc_id") % 3
    home = F.when(level == 0, dirs[0]).when(level == 1, F.concat_ws("/", *dirs[:2])).otherwise(F.concat_ws("/", *dirs))
    path = F.when(is_license, F.concat(home, F.lit("/LICENSE-"), "doc_id")).otherwise(F.concat(F.concat_ws("/", *dirs), F.lit("/"), "doc_id"))
    out = scan_licenses(docs.withColumn("path", path), license_file_pattern=r"(^|/)LICENSE-\d+$")
    return out.select("doc_id", "path", "license_id", "score", F.array_join("licenses", ",").alias("licenses"), "origin", "license_path")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_read(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Turns of a dialogue that make one row of the query's result.
PART_TURNS = 64


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue as each participant's, in parts of 64 turns; masks as text, such as 12-40,81-97."""
    out = render_dialogues(rotate_perspectives(_read(spark, sf_dir, "conversations")), PART_TURNS)
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "rendered", masks.alias("masks"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_quality(docs, labels.where(~held))
    return score_quality(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def _op10_sql() -> str:
    name = "name"
    for char, code in NAME_CODES:
        given = f"chr({ord(char)})" if char in "\r\n" else f"'{char}'"
        name = f"replace({name}, {given}, '{code}')"
    return f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS name,
                  regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id AS c, name AS perspective FROM t WHERE name <> 'system'),
r AS (SELECT t.*, who.perspective,
             CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END AS role
      FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.c),
h AS (SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || {name} ELSE '' END || '|>' || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment, turn // {PART_TURNS} AS part FROM h),
o AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn, name, segment))
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(segment, '' ORDER BY rn) AS rendered,
       coalesce(string_agg(CAST(CAST(ahead + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ahead + length(head) + length(text) + 7 AS BIGINT) AS VARCHAR), ',' ORDER BY rn)
         FILTER (WHERE role = 'assistant'), '') AS masks
FROM o GROUP BY conv_id, perspective, part
"""


def _op6_sql(rounds: int = 40) -> str:
    """The rake unrolled: one common table for each marginal of each round."""
    dims = ("source", "lang", "topic")
    head = """WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN (length(text) - length(translate(text, '#$%&*!', ''))) * 20 >= length(text) THEN 'symbols'
  WHEN length(text) - length(replace(text, chr(10), '')) >= 8 THEN 'sections' WHEN length(text) < 400 THEN 'notes' ELSE 'prose' END AS topic, text FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d WHERE n_tokens > 0 GROUP BY ALL)"""
    parts = [head]
    for k in dims:
        parts.append(f"p_{k} AS (SELECT {k}, pow(sum(t), 0.5) AS g FROM c GROUP BY {k}), q_{k} AS (SELECT {k}, g / (SELECT sum(g) FROM p_{k}) AS q FROM p_{k})")
    parts.append("w0 AS (SELECT source, lang, topic, t, t / (SELECT sum(t) FROM c) AS w FROM c)")
    n = 0
    for _ in range(rounds):
        for k in dims:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, t, w * q / sum(w) OVER (PARTITION BY {k}) AS w FROM w{n} JOIN q_{k} USING ({k}))")
            n += 1
    parts.append(f"r AS (SELECT *, w / (SELECT sum(w) FROM w{n}) * (SELECT sum(t) FROM c) / t AS r FROM w{n})")
    parts.append("""o AS (SELECT *, row_number() OVER v AS place, coalesce(sum(t) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(r * t) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM r WINDOW v AS (ORDER BY r DESC, source, lang, topic))""")
    parts.append("s AS (SELECT *, (0.5 * (SELECT sum(t) FROM c) - above) / below AS scale FROM o)")
    parts.append("k AS (SELECT place AS kp, scale AS ks FROM s WHERE scale * r <= 1 + 1e-12 ORDER BY place LIMIT 1)")
    parts.append("e AS (SELECT source, lang, topic, r, CASE WHEN place < kp THEN 1.0 ELSE least(1.0, ks * r) END AS p FROM s, k)")
    return (
        ",\n".join(parts)
        + """
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(CASE WHEN n_tokens > 0 THEN r ELSE 0 END, 6) AS weight,
  round(CASE WHEN n_tokens > 0 THEN p ELSE 0 END, 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN n_tokens > 0 THEN p ELSE 0 END AS sampled
FROM d LEFT JOIN e USING (source, lang, topic)"""
    )


def _op7_sql(min_score: float = 0.6, min_margin: float = 0.01) -> str:
    terms = "list_filter(list_transform(string_split_regex(lower(p), '[^a-z0-9.+-]+'), lambda x: trim(x, '.+-')), lambda x: x <> '')"
    given = ", ".join(f"({t}, '{i}', '{w}', {n}, {m}, {v})" for t, i, w, n, m, v in template_terms())
    known = ", ".join(f"('{i.lower()}', '{i}')" for i in sorted({t.license_id for t in TEMPLATES}))
    return f"""WITH f AS (SELECT doc_id, text, source, lang, CAST(doc_id // 100 AS VARCHAR) AS blk,
  coalesce(regexp_matches(text, '{CUES}') AND len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) <= 40, false) AS lic FROM documents),
files AS (SELECT doc_id, text, lic, CASE WHEN NOT lic THEN concat(source, '/', lang, '/', blk) WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN concat(source, '/', lang)
  ELSE concat(source, '/', lang, '/', blk) END AS dir FROM f),
named AS (SELECT *, concat(dir, CASE WHEN lic THEN '/LICENSE-' ELSE '/' END, doc_id) AS path FROM files),
raw AS (SELECT path, unnest(list_concat([text], regexp_extract_all(text, '(?m)((?:^{COMMENT}[^\\n]*(?:\\n|$))+)', 1), string_split_regex(text, '\\n(?:[ \\t]*\\n)+'), string_split(text, chr(10)))) AS p
  FROM named WHERE regexp_matches(text, '{CUES}')),
pass AS (SELECT DISTINCT path, regexp_replace(regexp_replace(p, '(?m)^{COMMENT}+', ' ', 'g'), '\\s+', ' ', 'g') AS p FROM raw WHERE regexp_matches(p, '{CUES}') AND NOT regexp_matches(p, '{NEGATED}')),
tf AS (SELECT path, p, term, count(*) AS tf FROM (SELECT path, p, unnest({terms}) AS term FROM pass) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT path, p FROM tf)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT v.*, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM (VALUES {given}) v(t, l, term, c, must, never) LEFT JOIN df USING (term), n),
tn AS (SELECT t, sqrt(sum(c * idf * c * idf)) AS norm, count_if(must) AS asked FROM g GROUP BY t),
own AS (SELECT path, p, term, tf * coalesce(idf, {OTHER}) AS x FROM tf LEFT JOIN (SELECT DISTINCT term, idf FROM g) USING (term)),
size AS (SELECT path, p, sqrt(sum(x * x)) AS size FROM own GROUP BY ALL),
sc AS (SELECT path, p, t, l, sum(x * c * idf / norm) / any_value(size) AS s, any_value(asked) AS asked, count_if(must) AS held, count_if(never) AS barred
  FROM own JOIN g USING (term) JOIN tn USING (t) JOIN size USING (path, p) GROUP BY path, p, t, l),
byl AS (SELECT path, p, l, round(least(1.0, max(s)), 6) AS s FROM sc WHERE held = asked AND barred = 0 GROUP BY path, p, l),
top AS (SELECT *, row_number() OVER w AS rn, lead(s) OVER w AS second FROM byl WINDOW w AS (PARTITION BY path, p ORDER BY s DESC, l)),
told AS (SELECT path, 1 AS kind, s, l FROM top WHERE rn = 1 AND s >= {min_score} AND (second IS NULL OR s - second >= {min_margin})),
ids AS (SELECT path, unnest(regexp_extract_all(regexp_replace(x, '{EXCEPTION}', '', 'g'), '{IDENTIFIER}')) AS i FROM (SELECT path, unnest(regexp_extract_all(text, '{DECLARED}', 1)) AS x FROM named)),
decl AS (SELECT path, 0 AS kind, 1.0 AS s, coalesce(known, i) AS l FROM (SELECT path, regexp_replace(i, '{VERSIONS}', '') AS i FROM ids WHERE NOT regexp_matches(i, '{OPERATOR}')) LEFT JOIN (VALUES {known}) v(low, known) ON lower(i) = low),
every AS (SELECT * FROM told UNION ALL SELECT * FROM decl),
best AS (SELECT path, l AS license_id, s AS score, ls FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY kind, s DESC, l) AS place FROM every) JOIN
  (SELECT path, array_to_string(list_sort(list_distinct(list(l))), ',') AS ls FROM every GROUP BY path) USING (path) WHERE place = 1),
a AS (SELECT named.*, license_id AS own_id, score AS own_score, ls FROM named LEFT JOIN best USING (path)),
held AS (SELECT dir AS up, path AS hp, own_id AS hl, own_score AS hs FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) AS rn FROM a WHERE lic AND own_id IS NOT NULL) WHERE rn = 1),
near AS (SELECT dir, hp, hl, hs FROM (SELECT d.dir, h.*, row_number() OVER (PARTITION BY d.dir ORDER BY length(up) DESC) AS rn FROM (SELECT DISTINCT dir FROM a) d JOIN held h ON d.dir = h.up OR starts_with(d.dir, concat(h.up, '/'))) WHERE rn = 1)
SELECT doc_id, path, coalesce(own_id, hl) AS license_id, CASE WHEN own_id IS NOT NULL THEN own_score ELSE hs END AS score, coalesce(ls, hl) AS licenses,
  CASE WHEN own_id IS NOT NULL THEN 'own' WHEN hl IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own_id IS NOT NULL THEN path ELSE hp END AS license_path
FROM a LEFT JOIN near USING (dir)"""


def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd rounds unrolled: one table of assignments and one codebook for each."""
    out = [f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // {parts} AS w FROM e),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * w + 1 : part * w + w] AS x FROM e, w, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries})) USING (vec_id))"""]
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (SELECT vec_id, label, p.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, x
  FROM p JOIN c{r} ON p.part = c{r}.part),
a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label, min(d) AS d, arg_min(entry, struct_pack(d := d, entry := entry)) AS entry, any_value(x) AS x FROM d{r} GROUP BY vec_id, part)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT part, entry, k, CAST(floor(sum(z) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
  FROM (SELECT part, entry, unnest(range(len(x))) AS k, unnest(x) AS z FROM a{r}) GROUP BY part, entry, k),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT part, entry, list(m ORDER BY k) AS m FROM s{r} GROUP BY part, entry) USING (part, entry))""")
    return (
        ",\n".join(out)
        + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"""
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embeddings": op1_embeddings,
        "op2_decontam": op2_decontam,
        "op3_langid": op3_langid,
        "op4_substring": op4_substring,
        "op5_simhash": op5_simhash,
        "op6_mixing": op6_mixing,
        "op7_licenses": op7_licenses,
        "op8_sharding": op8_sharding,
        "op9_html": op9_html,
        "op10_chat": op10_chat,
        "op11_quality": op11_quality,
        "op12_vector_codes": op12_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": _op6_sql(), "op7_licenses": _op7_sql(), "op10_chat": _op10_sql(), "op12_vector_codes": _op12_sql()}
