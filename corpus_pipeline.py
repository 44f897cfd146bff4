"""A corpus from documents: toxic ones go, poor ones go, one of each group of
near copies stays, sources are mixed to their weights, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectraflow.llm import mixing, packing, quality, simhash, toxicity
from spectraflow.llm.common import materialise
from spectraflow.llm.encoding import public_path

#: Texts are fitted by iteration and encoded by a tokenizer, which SQL can't express.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; null and empty texts, ties and repeated rows stay. Labels of documents that aren't in ``docs`` don't matter."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, null and empty texts among them, or are more likely poor than good go."""
    return quality.good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; rows that repeat it, or have no doc_id, too.

    Texts alike in 0.8 of their five-word shingles have fingerprints up to about 12 bits apart; those are the candidates, whose shingles are compared.
    """
    return simhash.one_of_each(docs, verified=True, radius=12)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it, in training order, which the written files keep. Repeated rows count each."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their token ids; runs of 10,000 documents are packed together, so sequence ids rise in training order."""
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"), with_ids=True, in_order=True)


STAGES = [("toxicity", clean), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every one but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
