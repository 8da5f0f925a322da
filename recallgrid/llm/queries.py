"""The queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, minhash, packing, quality, repair, search, simhash, suffix_dedup, suffix_lm, token_counts, toxicity
from .common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_all(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, seed=42, most=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_documents(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=100))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = minhash.edited_pairs(read(spark, sf_dir, "documents"))
    prints = (minhash.digits(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair.with_all(repair.repair(repair.damaged(conversations)), conversations)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_simhash, op4_suffix_lm, op5_suffix_dedup, op6_packing, op7_token_counts, op8_ann, op9_toxicity, op10_minhash, op11_search, op12_repair, op13_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {}
