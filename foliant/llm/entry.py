"""Queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, collocations, common, divergence, jaccard, language, licenses, media, oracles, packing, pieces, pii, quality, substring, tokens


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    common.slim(spark)
    return common.documents(spark, sf_dir, *cols)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(documents(spark, sf_dir), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return language.identified(docs, language.learn(docs))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(documents(spark, sf_dir, "lang", "source", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "lang", "text"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_jaccard_join": oracles.NGRAM_JACCARD, "op8_substring_dedup": oracles.SUBSTRING, "op11_divergence": oracles.DIVERGENCE, "op12_collocations": oracles.COLLOCATIONS}
