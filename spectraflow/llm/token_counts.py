"""Token counts through a digest cache.

A count depends on the text and on the tokenizer alone, so it is stored under
the SHA-256 of the normalised text and the tokenizer file's digest. Only
distinct digests that the cache lacks are encoded; their counts are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, fresh_dir
from spectraflow.llm.encoding import encoder, version

CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"


def normalised(text):
    """What is counted: a null text is an empty one. Nothing else is changed, as it could change the count."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; empty before the first append."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
        stored = stored.where(F.col("tokenizer") == tokenizer)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a shared folder kept between calls; without it the call gets a
    new one. Null and empty texts count 0 tokens, repeated rows are counted
    once and returned as often as they come in, an empty table gives an empty
    one, null doc_ids are kept, other columns aren't read. Copies of a text,
    however many, meet only as narrow rows, pre-aggregated by digest.
    """
    spark = documents.sparkSession
    cache = cache or fresh_dir(spark, "token-cache")
    tokenizer = version(tokenizer_path)
    texts = documents.select("doc_id", normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))

    stored = read_cache(spark, cache, tokenizer)
    missing = texts.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(stored, "digest", "left_anti")
    chosen = texts.alias("t").join(
        missing.alias("m"),
        (F.col("t.digest") == F.col("m.digest")) & F.col("t.doc_id").eqNullSafe(F.col("m.first_id")),
        "left_semi",
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(tokenizer_path), ("", 0)
        for batch in batches:
            digests, counts = batch.column("digest"), []
            for digest, text in zip(digests.to_pylist(), batch.column("text").to_pylist()):
                if digest != last[0]:  # copies under one doc_id follow each other
                    last = digest, own.count(text)
                counts.append(last[1])
            yield batch_of(["digest", "n_tokens", "tokenizer"], [digests, (counts, pa.int64()), ([tokenizer] * len(counts), pa.string())])

    misses = chosen.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).dropDuplicates(["digest"])
    misses.write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, tokenizer)
    keyed = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
