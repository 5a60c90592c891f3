"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import jaccard, language, licenses, packing, pieces, quality, rules, spelling, tokenfile, toxicity, vafile, wordpiece
from .common import in_fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 5, 0)
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held, held)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 4, 2)
    return language.identify(table(spark, sf_dir, "documents"), F.col("doc_id").isNotNull() & ~held, held)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 3, 1)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held, held)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("removed_lines")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard(table(spark, sf_dir, "documents")).drop("sig")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.counts(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.cluster(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op2_license_scan": op2_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_counts": op9_token_counts,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op10_toxicity": op10_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op11_token_files": op11_token_files,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op3_exact_dedup": """
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)""",
    "op5_quality_rules": rules.oracle(),
    "op12_centroid_clustering": vafile.oracle(),
}
