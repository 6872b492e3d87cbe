"""The contract queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import chat, decontaminate, dedup, licences, mixing, pii, quality, sharding, substring_dedup, token_files
from plotweave.llm.common import scratch_path, table


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.ring_shards(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(docs, folder)


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = quality.line_frequency(table(spark, sf_dir, "documents"), reread=False)
    return verdicts.drop("_host", "_text_hash")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op8_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(table(spark, sf_dir, "documents"))


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_hyperminhash, op2_chat_snapshots, op3_ring_shards, op4_token_files, op5_line_frequency, op6_spaced_seeds, op7_licence_digests, op8_disguised_pii, op9_fair_mix, op10_difference_cover, pipeline)}
