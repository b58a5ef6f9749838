"""Stages that turn documents into token digests of a clean, deduplicated, mixed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, exact_dedup, mixing, quality, queries, simhash
from tessella.llm.common import documents, new_path, remove, scratch, with_own_names
from tessella.llm.pieces import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the weighed votes keep."""
    return with_own_names(docs, quality.keep_good)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return with_own_names(docs, exact_dedup.drop_exact_duplicates)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates, verified by five-word shingles."""
    return with_own_names(docs, simhash.drop_near_copies)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes; a piece taken again is a row again."""
    return with_own_names(docs, mixing.mixed_documents)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every piece, as digests."""
    return queries.token_digests(bpe.encode_documents(docs, vocabulary_path("byte_bpe_50k.tiktoken"), decoded=True))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("mix sources", mixed_sources),
    ("byte-level bpe", token_digests),
]
#: Fitting, chance and byte pair merges can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    A stage's own tables are removed once it is written, and so is the table that it read.
    """
    docs, read = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read:
            remove(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
