"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import bitpack, host_reputation, isomedia, langid, nbsvm, ngram_join, order_minhash, packing, prefix_trie, spm_fst, substring_dedup, toxicity, whitening
from auditloom.llm._common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))


def op5_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_fst.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"))


def op9_url_reputation_evidenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"), evidenced=True)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.media_table(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_order_minhash": op2_order_minhash,
        "op3_language_id": op3_language_id,
        "op4_ngram_join": op4_ngram_join,
        "op5_bitpack": op5_bitpack,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_url_reputation": op9_url_reputation,
        "op9_url_reputation_evidenced": op9_url_reputation_evidenced,
        "op10_media": op10_media,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_url_reputation": host_reputation.ORACLE_SQL,
        "op9_url_reputation_evidenced": host_reputation.EVIDENCED_SQL,
        "op11_substring_dedup": substring_dedup.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
