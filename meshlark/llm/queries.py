"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.warc import archive_and_read

    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meshlark.llm.token_counts import count_tokens

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
named AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS source_id
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (source_id - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS all_words
  FROM named),
leveled AS (
  SELECT *, (all_words - coalesce(sum(cap) OVER (ORDER BY cap / w, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
sources AS (
  SELECT source, source_id, CAST(source_size AS BIGINT) AS source_size,
         least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER (), 'inf'::DOUBLE) * w) AS target
  FROM leveled),
needs AS (
  SELECT source_id, CAST(ceil(source_size / 128.0::DOUBLE) AS BIGINT) AS blocks,
         target * CAST(ceil(source_size / 128.0::DOUBLE) AS BIGINT) / source_size AS need
  FROM sources WHERE target > 0),
bounds AS (
  SELECT source_id, blocks, CAST(round(sum(need) OVER (ORDER BY source_id) / sum(need) OVER () * 4294967296) AS BIGINT) AS high FROM needs),
ranges AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source_id), 0) AS low FROM bounds),
slots AS (
  SELECT t AS slot, (t % 4294967296 * 2654435769) % 4294967296 AS point
  FROM range((SELECT CAST(coalesce(ceil(round(sum(need), 6)), 0) AS BIGINT) FROM needs)) r(t)),
ranked AS (
  SELECT source_id, blocks, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS r
  FROM slots JOIN ranges ON point >= low AND point < high),
takes AS (SELECT source_id, r % blocks AS block, count(*) AS times FROM ranked WHERE r < 2 * blocks GROUP BY 1, 2),
placed AS (
  SELECT z.*, s.source_id, s.source_size, s.target,
         coalesce(sum(size) OVER (PARTITION BY s.source_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source),
pieces AS (
  SELECT p.source_id, start, b AS block, least(start + size, (b + 1) * 128) - greatest(start, b * 128) AS piece
  FROM placed p, LATERAL (SELECT unnest(range(CAST(start // 128 AS BIGINT), CAST((start + size - 1) // 128 + 1 AS BIGINT))) AS b) WHERE size > 0),
taken AS (SELECT source_id, start, sum(piece * times) AS taken FROM pieces JOIN takes USING (source_id, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM placed LEFT JOIN taken USING (source_id, start)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.toxicity import toxicity

    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.embeddings import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.substrings import dedup_substrings

    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.pii import find_pii

    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlark.llm.minhash import fingerprint_with_next

    return fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_token_counts": op2_token_counts,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_simhash": op5_simhash,
        "op6_fingerprints": op6_fingerprints,
        "op7_embeddings": op7_embeddings,
        "op8_substrings": op8_substrings,
        "op9_packing": op9_packing,
        "op10_pii": op10_pii,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_mixing": OP3_SQL}
