"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (alignment, binary_topk, byte_cnn, chat_views, exact_dedup, lexical, mix_sources, ngram_join, packing,
               repeats, secrets, toxicity, url_filters)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The rules of the URL filter (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block"))


def q_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def q_url_filters(spark, sf_dir):
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_filters.judge_urls(read(spark, sf_dir, "pages"), rules)


def q_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"),
                                    read(spark, sf_dir, "labels"))


def q_packing(spark, sf_dir):
    return packing.pieces_report(read(spark, sf_dir, "documents"))


def q_suffix_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def q_chat_views(spark, sf_dir):
    return chat_views.rotate_report(read(spark, sf_dir, "conversations"))


# Neighbours asked for, and which rows ask.
TOP_K, QUERY_EVERY = 10, 100


def q_binary_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return binary_topk.top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0), TOP_K)


def q_language_id(spark, sf_dir):
    return byte_cnn.identify(read(spark, sf_dir, "documents"))


def q_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def q_mix_sources(spark, sf_dir):
    return mix_sources.mix(read(spark, sf_dir, "documents"))


def q_secrets(spark, sf_dir):
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def q_lexical_search(spark, sf_dir):
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def q_tokenizer_alignment(spark, sf_dir):
    return alignment.report(read(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_ngram_join": q_ngram_join,
        "op2_url_filters": q_url_filters,
        "op3_toxicity": q_toxicity,
        "op4_chat_views": q_chat_views,
        "op5_packing": q_packing,
        "op6_exact_dedup": q_exact_dedup,
        "op7_binary_topk": q_binary_topk,
        "op8_mix_sources": q_mix_sources,
        "op9_suffix_repeats": q_suffix_repeats,
        "op10_language_id": q_language_id,
        "op11_secrets": q_secrets,
        "op12_lexical_search": q_lexical_search,
        "op13_tokenizer_alignment": q_tokenizer_alignment,
        "pipeline": corpus_pipeline.run,
    }


# Each statement is written from the operator's contract, flat and without its
# hashing or histograms.
URL_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
hit AS (
  SELECT p.n, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule,
    arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
    AND starts_with(p.path, r.path)
  GROUP BY p.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN hit USING (n)"""

DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER b, 0) AS caps,
    sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest_w
  FROM s WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min((total - caps) / rest_w, cap / w) AS water FROM f
  WHERE (total - caps) / rest_w <= cap / w),
t AS (
  SELECT source, source_size,
    CASE WHEN water IS NULL OR cap / w < water THEN cap::DOUBLE ELSE water * w END AS target
  FROM f, l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats
  FROM t),
v AS (
  SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (
  SELECT r.source, v.h, v.words, r.target - r.repeats * r.source_size AS budget,
    coalesce(sum(v.words) OVER (PARTITION BY r.source ORDER BY v.h
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source),
e AS (
  SELECT source, max(CASE WHEN below < budget AND (budget - below >= below + words - budget)
                          THEN h + 1 WHEN below < budget THEN h ELSE 0 END) AS cut
  FROM c GROUP BY source)
SELECT doc_id, size, r.source_size, r.target,
  (size * (r.repeats + CASE WHEN h < coalesce(e.cut, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(floor(turn / 256), 0)::BIGINT AS part, turn,
    replace(coalesce(text, ''), '<|', '< |') AS text,
    CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE replace(role, '<|', '< |') END AS role
  FROM conversations),
v AS (
  SELECT t.*, s.speaker,
    CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
         WHEN t.role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user ' || t.role || '|>' || chr(10) END AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system') s
    ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS seg,
    row_number() OVER w AS n,
    coalesce(sum(length(head) + length(text) + 8) OVER (
      PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM v WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text)),
g AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(seg, '' ORDER BY n) AS text,
    string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(r.text) + 7)::BIGINT,
               ',' ORDER BY n) FILTER (WHERE role = speaker) AS mask
  FROM r GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start,
  n_turns, text, coalesce(mask, '') AS mask
FROM g"""

TOPK_SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
    len(list_filter(list_zip(q.embedding, v.embedding), lambda z: (z[1] > 0) <> (z[2] > 0)))::INT
      AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank
  FROM d)
SELECT query_id, rank::INT AS rank, neighbor_id, distance FROM r WHERE rank <= 10"""


LEXICAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
s AS (
  SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS total FROM d),
m AS (
  SELECT r, doc_id, 100 - 50 + (50 * len(ts) * n_docs) // total AS m FROM d, s),
q AS (
  SELECT i, item_id, unnest(list_distinct(ts)) AS t FROM (
    SELECT row_number() OVER () AS i, item_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM benchmark) b),
p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) u
  WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, s GROUP BY t, n_docs),
c AS (
  SELECT i, item_id, doc_id, r,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, item_id, doc_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM c WHERE score > 0) x
WHERE rank <= 50"""


def oracle_sql():
    return {
        "op2_url_filters": URL_SQL,
        "op4_chat_views": CHAT_SQL,
        "op6_exact_dedup": DEDUP_SQL,
        "op7_binary_topk": TOPK_SQL,
        "op8_mix_sources": MIX_SQL,
        "op12_lexical_search": LEXICAL_SQL,
    }
