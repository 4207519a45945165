"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import exact_dedup, license_scan, line_dedup, mixing, multi_length, packing, quality_classifier, quality_rules, repair, sharding, simhash_trie, token_counts, whitening
from quillsift.llm.shared import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARD_BYTES = 64 << 20
#: Documents whose labels nothing is learned from.
HELD_OUT = "(crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 3 = 1)"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, read(spark, sf_dir, "labels"), f"NOT {HELD_OUT}")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE).drop("text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op9_balanced_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.group_near(read(spark, sf_dir, "documents"), words=3, budget=3)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), top=4)


def op12_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_length.pack_multi(read(spark, sf_dir, "documents"), WORD_BPE, largest=4096)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(read(spark, sf_dir, "conversations"))


QUERIES = (
    op1_quality_rules,
    op2_extendible_sharding,
    op3_best_fit_packing,
    op4_line_dedup,
    op5_exact_dedup,
    op6_quality_classifier,
    op7_token_counts,
    op8_license_scan,
    op9_balanced_mixing,
    op10_simhash_near_dedup,
    op11_embedding_whitening,
    op12_multi_length_packing,
    op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_extendible_sharding": sharding.oracle(SHARD_BYTES),
        "op4_line_dedup": line_dedup.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
    }
