"""The registered query of each operator, over its whole table, and the SQL to hold it against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.ann import nearest
from tidewater.llm.byte_bpe import encode_decode
from tidewater.llm.embedding_dedup import embedding_groups
from tidewater.llm.language_id import identify_language, is_held_out, train_language_id
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.mixing import mix_sources
from tidewater.llm.ngram_join import jaccard_groups
from tidewater.llm.quality import classify_quality
from tidewater.llm.secrets import find_secrets, span_text
from tidewater.llm.token_counts import count_tokens

def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = jaccard_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85, with_links=True)
    return grouped.select(F.col("_id").alias("doc_id"), F.col("_n_shingles").alias("n_shingles"), F.col("_group").alias("component_id"), F.col("_n_links").alias("n_links"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    names = {"_id": "doc_id", "_n": "n_scored", "_perplexity": "perplexity", "_low": "low", "_high": "high", "_kept": "kept"}
    return scored.select(*[F.col(a).alias(b) for a, b in names.items()])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_id(docs.where(~is_held_out()))
    named = identify_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", is_held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("_n_tokens").alias("n_tokens"),
        (F.col("_n_tokens") > 2048).alias("over_limit"),
        F.col("_fits_chars").alias("fits_chars"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s["base"])
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("_spans")).alias("spans"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = embedding_groups(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)
    return grouped.select(F.col("_id").alias("vec_id"), F.col("_n_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_nearest": op7_nearest,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM docs GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM sources),
levels AS (SELECT *, most / weight AS level FROM weighed),
commons AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS common
  FROM levels WINDOW before AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN level <= common THEN most ELSE (SELECT common FROM commons WHERE level > common ORDER BY level, rank LIMIT 1) * weight END AS target FROM commons),
placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM placed
""",
    "op2_ngram_join": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams FROM texts),
sized AS (SELECT doc_id, len(grams) AS n, grams FROM sets),
lists AS (SELECT doc_id, n, unnest(grams) AS gram FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM lists a JOIN lists b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM sized JOIN named USING (doc_id) LEFT JOIN counted USING (doc_id)
""",
    "op9_secrets": r"""
WITH patterns(rank, kind, pattern) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]{16,}'),
  (2, 'hex', '[0-9a-f]{24,}'),
  (3, 'identifier', '(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}|(?:[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{4,}'),
  (4, 'key', '[A-Za-z0-9+/_=-]{32,}'),
  (5, 'endpoint', '(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\x09-\x0D"''<>]{4,}')),
found AS (
  SELECT doc_id, rank, kind, regexp_extract_all(coalesce(text, ''), pattern) AS matches, regexp_extract_all(coalesce(text, ''), pattern, 2) AS inner_,
         list_transform(string_split_regex(coalesce(text, ''), pattern), lambda x: length(x)) AS gaps FROM documents, patterns WHERE rank = 0
  UNION ALL
  SELECT doc_id, rank, kind, regexp_extract_all(coalesce(text, ''), pattern) AS matches, [] AS inner_,
         list_transform(string_split_regex(coalesce(text, ''), pattern), lambda x: length(x)) AS gaps FROM documents, patterns WHERE rank > 0),
single AS (SELECT doc_id, rank, kind, unnest(matches) AS m, CASE WHEN rank = 0 THEN unnest(inner_) END AS value, unnest(gaps[1:len(matches)]) AS gap, generate_subscripts(matches, 1) AS nth FROM found),
ended AS (SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY nth) AS BIGINT) AS stop FROM single),
spans AS (
  SELECT doc_id, rank, kind, stop - length(m) AS start, stop FROM ended
  WHERE CASE rank WHEN 0 THEN length(value) >= 6 WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
linked AS (
  SELECT s.doc_id, s.rank AS s_rank, s.kind AS s_kind, s.start AS s_start, s.stop AS s_stop, p.rank AS p_rank, p.kind AS p_kind, p.start AS p_start, p.stop AS p_stop
  FROM spans s JOIN spans p ON s.doc_id = p.doc_id AND s.kind IN ('assign', 'key', 'hex') AND p.kind IN ('access', 'identifier', 'endpoint')
   AND p.start <= s.stop + 200 AND p.stop >= s.start - 200 AND (p.stop <= s.start OR p.start >= s.stop)),
reported AS (
  SELECT doc_id, rank, kind, start, stop FROM spans WHERE rank < 3
  UNION SELECT doc_id, s_rank, s_kind, s_start, s_stop FROM linked WHERE s_rank >= 3
  UNION SELECT doc_id, p_rank, p_kind, p_start, p_stop FROM linked WHERE p_rank >= 3)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM documents d LEFT JOIN reported r USING (doc_id) GROUP BY d.doc_id
""",
    "op4_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
keys AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keys.*, shared.k IS NOT NULL AND keeper <> doc_id AS gone FROM keys LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
