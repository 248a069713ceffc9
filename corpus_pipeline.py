"""A training-corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesift.llm import decontaminate, mixing, quality, simhash, token_output
from pagesift.plans.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep.

    Null, empty and short texts go; a null source is a host; equal rows are judged alike. Like all stages but the
    last it takes texts of any length, gives no rows for an empty table, and keeps all columns as they are, whatever
    their names.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates by five-word shingles, found exactly.

    Texts without words are equal to one another; rows with a null doc_id stay; rows that share a doc_id stay together.
    """
    return simhash.deduplicate(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null texts are clean, and an empty benchmark removes none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, in repeated rows; ties of size are cut by a hash."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written token ids, read back: doc_id, start, n_tokens, ids_crc32; a null or empty text has the end id alone."""
    return token_output.report(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixture),
    ("token-id output", token_ids),
]

#: Tokenization and XXH64 are not SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, writing each stage's rows and reading them again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k + 1}")
    return docs
