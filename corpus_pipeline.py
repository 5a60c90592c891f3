"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before kept; run() writes each result as
Parquet into the shared folder, reads it again and then deletes the one before.
Repeated and null doc_ids are kept apart by their texts; null text counts as
empty; an empty table passes through; very long texts are documents like any
other; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.llm import exact_dedup, jaccard, language, packing, toxicity
from seqgraph.llm.common import in_fold, materialise, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go."""
    usable = F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), usable)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in no known language go."""
    usable = F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)
    return language.keep_known(docs, usable)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of linked texts, the row with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one row for each piece of a packed sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_foreign),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("best_fit_packing", pack),
]

#: The classifiers, the similarity join and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):  # what the stage has written on the way goes once its result is written
            docs = last = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", last, outside=True)
    return docs
