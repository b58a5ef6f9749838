"""Claims of an answer against the chunks of its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FaithfulnessConfig
from ..functions.scoring import PairScorer, coverage
from ..functions.text import claims, tokens
from .windows import windows


def split_claims(answers: DataFrame, config: FaithfulnessConfig = FaithfulnessConfig()) -> DataFrame:
    """(query_id, claim_no from 1, claim) of answers (query_id, answer)."""
    listed = claims(F.col("answer"), config.least_words, config.most_claims)
    return answers.select("query_id", F.posexplode(listed).alias("at", "claim")).select("query_id", (F.col("at") + 1).alias("claim_no"), "claim")


def check_claims(claimed: DataFrame, chunks: DataFrame, config: FaithfulnessConfig = FaithfulnessConfig(), scorer: PairScorer = coverage, window: int = 400) -> DataFrame:
    """Each claim's best entailment by the chunks (query_id, chunk_no, content) of its query, and that chunk.

    Of equals the earliest chunk counts; without a chunk, entailment is 0 and the chunk null. A long
    chunk is scored by windows; one that leaves no room for the claim is scored whole.
    """
    listed = claimed.withColumn("c", tokens(F.col("claim")))
    budget = F.lit(window) - F.size("c")
    told = chunks.select("query_id", "chunk_no", tokens(F.col("content")).alias("t"))
    parts = F.when(budget > 0, windows(F.col("t"), budget)).otherwise(F.array("t"))
    pairs = listed.join(told, "query_id").withColumn("entailment", F.array_max(F.transform(parts, lambda w: scorer(F.col("c"), w))))
    best = pairs.groupBy("query_id", "claim_no").agg(F.max(F.struct("entailment", (-F.col("chunk_no")).alias("order"))).alias("best"))
    out = claimed.join(best, ["query_id", "claim_no"], "left")
    entailment = F.coalesce("best.entailment", F.lit(0.0))
    chunk = F.when(entailment > 0, -F.col("best.order"))
    return out.select("query_id", "claim_no", "claim", F.round(entailment, 4).alias("best_entailment"), (entailment >= config.threshold).alias("faithful"), chunk.alias("supporting_chunk"))


def summarise(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """Per answer, also without claims: mean and largest of the rounded entailments, faithful claims, claims."""
    found = checked.groupBy("query_id").agg(F.avg("best_entailment").alias("mean_entailment"), F.max("best_entailment").alias("max_entailment"), F.count_if("faithful").alias("n_faithful"), F.count("*").alias("n_claims"))
    return answers.select("query_id").join(found, "query_id", "left").na.fill(0)
