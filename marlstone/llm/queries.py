"""The corpus operators applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, katz, media, mixing, packing, quality, sharding, simhash, urls, wordpieces


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_read(spark, sf_dir, "documents"), 24).drop("source")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_read(spark, sf_dir, "conversations"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.count(_read(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_sharding, op3_urls, op4_chat, op5_tokens, op6_media, op7_packing, op8_mixing, op9_quality, op10_katz)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2, "op3_urls": urls.sql(), "op8_mixing": OP8}


#: CRC-32 by its table of 256 values, which the query derives, over the UTF-8 bytes.
OP2 = r"""
WITH t AS MATERIALIZED (SELECT (SELECT list(list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, n) ORDER BY n) FROM range(256) r(n)) AS tbl),
b AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes,
         ('0x' || substr(md5('shard|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
c AS (SELECT doc_id, k, size, h, xor(list_reduce(bytes, lambda v, x: xor(v >> 8, tbl[(xor(v, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM b, t),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY k) AS n FROM c),
l AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1) / (2 * n), k, rank) - 1 AS place, count(*) OVER () AS everything FROM r),
s AS (SELECT *, (place * 24) // everything AS shard FROM l)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, place - (shard * everything + 23) // 24 AS slot, NULL::INT AS grown_shard FROM s
"""


OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT k, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY k),
a AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS everything FROM s),
l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
  FROM a),
c AS (SELECT *, (everything - before) * w >= cap * rest AS cut FROM l),
t AS (
  SELECT k, source_size,
         CASE WHEN cut THEN cap::DOUBLE
              ELSE w * (everything - coalesce(sum(cap) FILTER (WHERE cut) OVER (), 0)::DOUBLE) / (sum(w) FILTER (WHERE NOT cut) OVER ())::DOUBLE END AS target,
         ('0x' || substr(md5('mix|' || k), 1, 4))::BIGINT / 65536.0::DOUBLE AS u
  FROM c),
p AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         row_number() OVER (PARTITION BY k ORDER BY size, h, doc_id NULLS FIRST) - 1 AS pos
  FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       (least(floor((pos + 1) * e + u) - floor(pos * e + u), ceil(e)) * size)::BIGINT AS taken
FROM p
"""
