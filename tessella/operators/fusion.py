"""Reciprocal rank fusion of ranked lists, per domain or over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..storage import small


def ranked_lists(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both lists in one table with a ``source`` column."""
    return dense.withColumn("source", F.lit("dense")).unionByName(sparse.withColumn("source", F.lit("sparse")))


def fuse(lists: DataFrame, domains: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """One row per query, domain and chunk: the RRF score and both ranks and scores, null where missing.

    A chunk that a list has twice gets both terms. ``first`` orders ties: by the place of the domain in
    ``domains`` (domain, place), dense before sparse, and rank. The merge of the two lists and the sum are one
    aggregation.
    """
    placed = lists.join(small(domains.select("domain", "place")), "domain")
    is_dense = F.col("source") == "dense"
    first = F.min(F.struct("place", F.when(is_dense, 0).otherwise(1).alias("list"), "rank", "chunk_id")).alias("first")
    sides = [F.min(F.when(is_dense == want, F.col(c))).alias(f"{name}_{c}") for name, want in (("dense", True), ("sparse", False)) for c in ("rank", "score")]
    return placed.groupBy("query_id", "domain", "chunk_id").agg(F.sum(1 / (config.rrf_k + F.col("rank"))).alias("rrf"), first, *sides)


def per_domain(fused: DataFrame, domains: DataFrame) -> DataFrame:
    """The best of each domain up to its ``allocation``, domain after domain, with ``position`` from 1."""
    order = Window.partitionBy("query_id", "domain").orderBy(F.round("rrf", 12).desc(), "first")
    kept = fused.withColumn("domain_rank", F.row_number().over(order)).join(small(domains.select("domain", "allocation")), "domain").where("domain_rank <= allocation")
    place = Window.partitionBy("query_id").orderBy("first.place", "domain_rank")
    return kept.withColumn("position", F.row_number().over(place)).drop("allocation")


def over_all(fused: DataFrame, n: int = 10) -> DataFrame:
    """The best ``n`` of each query whatever their domain."""
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "first")
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def counts(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """Per query: rows of the dense and the sparse lists, and of what fusion kept."""
    before = lists.groupBy("query_id").agg(F.count_if(F.col("source") == "dense").alias("dense_count"), F.count_if(F.col("source") == "sparse").alias("sparse_count"))
    after = kept.groupBy("query_id").agg(F.count("*").alias("fused_count"))
    return before.join(after, "query_id", "left").na.fill(0, ["fused_count"])


def majority_domain(domains: DataFrame) -> DataFrame:
    """The domain of the largest allocation, the first of equals."""
    return domains.orderBy(F.desc("allocation"), "place").limit(1).select(F.col("domain").alias("majority_domain"))


def allocated(rows: DataFrame, configs: DataFrame, domains: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``rows`` (query_id, domain, ...) of the queries that are to be retrieved at all, with their domain's place and allocation.

    ``configs`` has query_id, should_retrieve (null: true) and allocation, a map from domain to places
    of the fused list; without one every domain gets an equal whole share.
    """
    wanted = configs.where(F.coalesce("should_retrieve", F.lit(True))).select("query_id", F.col("allocation").alias("shares"))
    share = F.when(F.col("shares").isNull(), F.floor(F.lit(config.fused / max(1, domains.count())))).otherwise(F.coalesce(F.try_element_at("shares", F.col("domain")), F.lit(0)))
    named = rows.join(wanted, "query_id").join(small(domains.select("domain", "place")), "domain")
    return named.withColumn("allocation", share.cast("int")).drop("shares")


def retrieved(fused: DataFrame, configs: DataFrame, domains: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """The candidates of every query that is to be retrieved: per domain up to its allocation, domain after domain.

    ``chunks`` has chunk_id, label, token_count and metadata_count; ``domains`` maps labels, in any case, to domains. A label that
    none has is ``unknown``. Of the two token counts the metadata's counts unless it is null or 0; without
    any it is 0. Scores are rounded to 4 places, rrf to 6.
    """
    order = Window.partitionBy("query_id", "domain").orderBy(F.round("rrf", 12).desc(), "first")
    kept = allocated(fused.drop("place").withColumn("domain_rank", F.row_number().over(order)), configs, domains, config).where("domain_rank <= allocation")
    placed = kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "domain_rank"))).drop("domain")
    named = chunks.join(domains.select(F.lower("label").alias("low"), "domain"), F.lower(F.trim("label")) == F.col("low"), "left")
    told = named.select("chunk_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce(F.nullif("metadata_count", F.lit(0)), "token_count", F.lit(0)).alias("token_count"))
    scores = [F.round(c, 4).alias(c) for c in ("dense_score", "sparse_score")]
    return placed.join(told, "chunk_id").select("query_id", "position", "chunk_id", "domain", "dense_rank", "sparse_rank", *scores, F.round("rrf", 6).alias("rrf"), "token_count")
