"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from ledgerloom.llm import chat, exact_dedup, lexical, mixing, near_dedup, packing, pii, quality, sharding, topk, toxicity, trie, wavelet
from ledgerloom.llm.common import materialized
from ledgerloom.llm.oracle import LLM_ORACLE
from ledgerloom.session import scratch_folder

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def best_matches(spark: SparkSession, folder: str) -> DataFrame:
    return topk.nearest(table(spark, folder, "embeddings"))


def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, folder, "documents")).drop("row_id")


def chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(materialized(chat.formatted(turns)))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.detected(table(spark, folder, "documents")))


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents")).drop("row_id")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents")).drop("group")


def tokenizer(name: str) -> str:
    """The file of a public tokenizer, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_folder(spark).rstrip('/')}/ledgerloom/tokens-{uuid.uuid4().hex}"
    return wavelet.documents(wavelet.written(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), path, added=True))


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), added=True))


def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, folder, "labels")))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digests(quality.judged(table(spark, folder, "documents")))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(table(spark, folder, "conversations"))


def whole_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": best_matches,
    "op2_exact_dedup": exact_copies,
    "op3_chat_formatting": chat_examples,
    "op4_pii": personal_data,
    "op5_mixing": mixture,
    "op6_minhash_near_dedup": near_copies,
    "op7_sharding": shards,
    "op8_token_files": token_files,
    "op9_packing": packed_sequences,
    "op10_toxicity": toxic_scores,
    "op11_quality_rules": quality_rules,
    "op12_lexical_search": lexical_search,
    "op13_conversation_trie": conversation_trie,
    "pipeline": whole_pipeline,
}
