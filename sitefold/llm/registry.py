"""Queries of the training-data operators with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm import oracles
from sitefold.llm.common import deleted, shared_folder, table
from sitefold.llm.quality import MAX_DUP_LINE_SHARE, MAX_SYMBOL_SHARE, MIN_DUP_LINES, SEVERE, SPREAD


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.decontam import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.templates import drop_templates

    return drop_templates(table(spark, sf_dir, "documents")).select("row.doc_id", "row.text", "n_lines", "n_dropped")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sitefold.llm.tokens import pack, scan

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    blocks = pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, separator=50256, folder=folder)
    counts = scan(blocks, separator=50256).select("doc_id", "n_tokens")
    deleted(spark, folder)
    return counts


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.spans import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.pii import find_personal_data, listed

    out = find_personal_data(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.neardup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sitefold.llm.bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("plain", 256).alias("plain_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.langid import held_out, identify

    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitefold.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pii": op5_pii,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op4_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_minhash_neardup": oracles.NEAR_DUPLICATES,
    "op10_quality_rules": oracles.quality(MAX_SYMBOL_SHARE, MIN_DUP_LINES, MAX_DUP_LINE_SHARE, SEVERE, SPREAD),
}
