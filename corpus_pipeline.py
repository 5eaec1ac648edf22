"""Documents to packed sequences, in five stages.

Each stage gets what the one before it kept, as a written table, and all but the last
return documents with their own columns. Toxic documents go, then exact and near
copies; sources, languages and topics are mixed to target token weights; whole
documents are packed into sequences."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from ledgerloom.session import scratch_folder

ORACLE_SQL = None  # label models, hashes drawn from texts and packing are beyond SQL


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.without_toxic(docs, toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def novel(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their weights."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), added=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", novel), ("mixing", mixed), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    base = f"{scratch_folder(spark).rstrip('/')}/ledgerloom/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
