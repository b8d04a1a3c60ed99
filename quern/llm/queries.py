"""The registered queries of this subpackage, each thin over its operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, dedup, jaccard, langid, lm_score, mixture, packing, token_file, topk, warc
from quern.llm.common import id_crc32, table


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), id_crc32(F.col("doc_id")) % 7 == 2)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.encode_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_taken(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = id_crc32(F.col("doc_id")) % 4
    model = langid.train(docs.filter(remainder != 2).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_and_digest(chat.with_planted(table(spark, sf_dir, "conversations")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_token_file": op2_token_file,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_warc_archive": op4_warc_archive,
    "op5_source_mix": op5_source_mix,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_pivot_topk": op10_pivot_topk,
}

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, i, least(cap, w * max(level) OVER ()) AS target FROM levels),
cuts AS (
  SELECT source, source_size, target, i, round(target)::BIGINT AS words, ceil(round(target) / 2048)::BIGINT AS need FROM targets),
bounds AS (
  SELECT i, need, (sum(words) OVER (ORDER BY i) - words)::DOUBLE / sum(words) OVER () AS low,
         (sum(words) OVER (ORDER BY i))::DOUBLE / sum(words) OVER () AS high FROM cuts WHERE words > 0),
points AS (
  SELECT slot, slot * 0.6180339887498949::DOUBLE + 0.5::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE + 0.5::DOUBLE) AS point
  FROM (SELECT unnest(range((SELECT coalesce(ceil(sum(words) / 2048.0), 0)::BIGINT FROM cuts))) AS slot)),
owned AS (
  SELECT i, need, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS rank
  FROM points JOIN bounds ON point >= low AND point < high),
lacking AS (
  SELECT b.i, b.need, coalesce(o.got, 0) AS got FROM bounds b LEFT JOIN (SELECT i, count(*) AS got FROM owned GROUP BY i) o ON o.i = b.i),
slots AS (
  SELECT i, rank, slot FROM owned WHERE rank < need
  UNION ALL
  SELECT i, rank, (SELECT count(*) FROM points) + (rank - got) * 16384 + i
  FROM (SELECT i, got, unnest(range(got, need)) AS rank FROM lacking WHERE got < need)),
placed AS (
  SELECT s.doc_id, s.size, c.i, c.source_size, c.target, c.words,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)
SELECT p.doc_id, p.size, p.source_size, p.target,
       (greatest(0, least(p.size, p.words - p.pos)) + greatest(0, least(p.size, p.words - p.source_size - p.pos)))::BIGINT AS taken,
       s.slot::BIGINT AS first_slot
FROM placed p LEFT JOIN slots s ON p.size > 0 AND p.pos < p.words AND s.i = p.i AND s.rank = p.pos // 2048
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id, strlen(html) AS n FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

ORACLE_SQL: dict[str, str] = {"op4_warc_archive": OP4_SQL, "op5_source_mix": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_pivot_topk": OP10_SQL}
