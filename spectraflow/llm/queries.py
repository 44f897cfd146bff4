"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraflow.llm import html_extract, media, mixing, packing, quality, sharding, simhash, token_codes, token_counts, toxicity
from spectraflow.llm.encoding import public_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_read(spark, sf_dir, "documents"), columns=["doc_id"])
    first = F.round(F.get("occurrences", F.lit(0))["position"], 6).alias("first_position")
    rows = planned.select("doc_id", "size", "source_size", "target", "taken", first)
    return rows.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def op2_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"), ["doc_id"])
    return judged.drop("votes").withColumn("quality", F.round("quality", 6))


def op5_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = token_codes.encode_documents(_read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return coded.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = media.media_columns(_read(spark, sf_dir, "documents"))
    return columns.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "bit_depth",
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("hash")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest_rows(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix, op2_count_tokens, op3_pack, op4_quality, op5_codes, op6_media, op7_near_duplicates, op8_toxicity, op9_extract, op10_shard]
    return {f.__name__: f for f in found}


#: Weights 1, 2, 3 of sources by rank, falling, level or rising; the level is the largest of those that follow from capping the k least caps per weight.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS digest FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
  w AS (SELECT *, CAST(1 + r % 3 AS DOUBLE) AS weight, (r % 3 - 1) * 0.5e0 AS tilt, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
  l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  t AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM l),
  p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, t.tilt, floor(t.target + 0.5e0) AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(words / source_size) ELSE 0 END AS passes FROM p),
  k AS (SELECT *, greatest(least(size, words - passes * source_size - before), 0) AS last FROM q),
  x AS (SELECT *, least((before + CASE WHEN passes > 0 THEN size ELSE last END / 2e0) / greatest(words, 1), 1e0) * weight AS x, weight * (1 - tilt) AS w0, 2 * weight * tilt AS slope FROM k),
  y AS (SELECT *, (w0 + weight) / 4e0 AS half FROM x)
  SELECT doc_id, size, source_size, target, CAST(size * passes + last AS BIGINT) AS taken, CASE WHEN passes = 0 AND last <= 0 THEN NULL WHEN x <= 0 THEN 0e0
    WHEN x <= half THEN round(2 * x / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * x, 0))), 6)
    ELSE round(0.5e0 + 2 * (x - half) / (weight + sqrt(greatest(weight * weight + 2 * slope * (x - half), 0))), 6) END AS first_position FROM y"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; crc32, tokenizers, fits and components it can't."""
    return {"op1_mix": MIX_SQL}
