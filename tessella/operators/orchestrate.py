"""Confidence of an answer from its reranker scores and its claims, and the response by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TierConfig


def aggregate(reranker: Column, faithfulness: Column, config: TierConfig = TierConfig()) -> Column:
    return F.round(config.reranker_weight * reranker + config.faithfulness_weight * faithfulness, 4)


def tier(confidence: Column, config: TierConfig = TierConfig()) -> Column:
    """Above ``high`` and ``moderate``, from ``low`` on, else dead."""
    return F.when(confidence > config.high, "high").when(confidence > config.moderate, "moderate").when(confidence >= config.low, "low").otherwise("dead")


def orchestrate(answers: DataFrame, placed: DataFrame, checked: DataFrame, config: TierConfig = TierConfig()) -> DataFrame:
    """Answers (query_id, answer) with signals, confidence, tier, citations and response.

    ``placed`` and ``checked`` are the tables of the reranker and of the claims; what is missing counts as 0.
    """
    inside = placed.where("in_context")
    scores = inside.groupBy("query_id").agg(F.median("score").alias("reranker_median"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("cited"))
    claims = checked.groupBy("query_id").agg(F.max("best_entailment").alias("max_entailment"))
    out = answers.join(scores, "query_id", "left").join(claims, "query_id", "left").na.fill(0, ["reranker_median", "max_entailment"])
    lines = F.transform("cited", lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), c["chunk_id"].cast("string"), F.lit(" ("), F.format_number(c["score"], 2), F.lit(")")))
    out = out.withColumn("confidence", aggregate(F.col("reranker_median"), F.col("max_entailment"), config)).withColumn("tier", tier(F.col("confidence"), config))
    out = out.withColumn("citations", F.when(F.size("cited") > 0, F.concat(F.lit("Sources:\n"), F.array_join(lines, "\n"))).otherwise("")).drop("cited")
    return out.withColumn("response", response(F.col("tier"), F.col("answer"), F.col("citations")))


def response(tier: Column, answer: Column, citations: Column) -> Column:
    """What a reader sees: a dead tier has no answer."""
    note = F.when(tier == "moderate", "Parts of this answer may be incomplete.\n\n").when(tier == "low", "The sources support this answer weakly.\n\n").otherwise("")
    tail = F.when(citations != "", F.concat(F.lit("\n\n"), citations)).otherwise("")
    return F.when(tier == "dead", "The sources do not answer this question.").otherwise(F.concat(note, F.coalesce(answer, F.lit("")), tail))
