"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest and ranked; a row's fractional
rank is (rank + 1/2) / rows of its source. In the order of fractional ranks
every stretch holds each source in proportion, so cutting that order into
equally many rows makes every shard match the mixture. DataFrame functions
only; no group, however hot, is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.llm.common import before, materialise, seeded, text_digest


def assign(rows: DataFrame, shards: int = 24, source: str = "source", key: str = "doc_id", seed: str = "shard", slices: int = 256, tell: str | None = "text") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0) to every row; row counts differ by one at most.

    The seeded order goes by ``key`` and the text in column ``tell`` (None: by
    ``key`` alone), so rows of one key, or without one, are spread and placed
    alike in every run; which of two rows with equal key and text comes first
    can't be told. Rows with a null source form a source of their own. Repeated
    rows are rows like others. An empty table gives an empty one. Columns named
    shard or slot are replaced, others kept whatever their names.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    digest, fraction = seeded(seed, F.col(key), *([text_digest(F.col(tell))] if tell else []))
    at = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    row = F.struct(*kept).alias("__row")
    keyed = rows.select(row, F.col(key).alias("__id"), at.alias("__source"), digest.alias("__digest"), fraction.alias("__at"))
    ranked = before(keyed, ["__source"], ["__digest", "__id"], F.col("__at"), slices, F.lit(1), "__rank")
    counts = keyed.groupBy("__source").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranked.join(counts, "__source").withColumn("__share", (F.col("__rank") + 0.5) / F.col("__n")).drop("__at", "__n")
    ranked = materialise(ranked, "shard-ranks")  # in one plan with what follows, the optimizer's constraints multiply
    placed = before(ranked, [], ["__share", "__source", "__digest", "__id"], F.col("__share"), slices * 4, F.lit(1), "__place")
    total = counts.agg(F.sum("__n").alias("__all"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    shard = F.floor(F.col("__place") * shards / F.col("__all"))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.ceil(F.col("shard") * F.col("__all") / F.lit(shards))
    return placed.withColumn("slot", F.col("__place") - first).select("__row.*", "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Write all columns, a folder per shard, rows in slot order. Large shards are several range-cut files."""
    placed = assign(rows, shards, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)


def digest_rows(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard (null: the law is rows)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_digest(F.col("text")).alias("text"))
    placed = assign(narrow, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
