"""Data operators around generation: prompts, confidence of tokens, abstention and a second attempt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import probability


#: Fixed phrases by which an answer says that its context doesn't hold it, in lower case.
ABSTENTIONS = [
    "does not contain sufficient information",
    "does not contain enough information",
    "cannot answer this question based on",
    "not enough information to answer",
    "insufficient information to answer",
    "no relevant information",
    "is not mentioned in the provided context",
    "is not mentioned in the context",
    "not mentioned in the provided context",
    "no information about",
    "does not mention",
    "does not provide information",
    "there is no information",
]


def prompt(question: Column, context: Column) -> Column:
    """The question, the delimited context, and the question again."""
    return F.concat(F.lit("Question: "), question, F.lit("\n\n<context>\n"), F.coalesce(context, F.lit("")), F.lit("\n</context>\n\nQuestion: "), question)


def factual_confidence(answers: DataFrame, below: float = 0.80) -> DataFrame:
    """(query_id, confidence, n_factual) of ``logprobs`` arrays: the median of the uncertain tokens.

    Factual tokens are those under ``below``. With no tokens both are 0; with no such token the
    median is that of all and the count 0.
    """
    p = answers.select("query_id", F.explode_outer("logprobs").alias("lp")).select("query_id", probability(F.col("lp")).alias("p"))
    found = p.groupBy("query_id").agg(F.median(F.when(F.col("p") < below, F.col("p"))).alias("few"), F.median("p").alias("all"), F.count_if(F.col("p") < below).alias("n_factual"))
    return found.select("query_id", F.coalesce("few", "all", F.lit(0.0)).alias("confidence"), "n_factual")


def overrides_context(confidence: Column, faithfulness: Column, sure: float = 0.75, unfaithful: float = 0.40) -> Column:
    """A sure answer that its context doesn't support."""
    return (confidence > sure) & (faithfulness < unfaithful)


def unmentioned_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Per query the sorted entities (query_id, entity) of its chunks that the question doesn't name, in any case."""
    pairs = entities.where("entity IS NOT NULL").join(queries, "query_id").where(F.instr(F.lower("question"), F.lower("entity")) == 0)
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def abstains(answer: Column, phrases: list[str]) -> Column:
    """Whether the answer has any of the phrases, in any case; null does not."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]).cast("array<string>"), lambda p: F.contains(low, p))


def retry(answers: DataFrame, placed: DataFrame, generate: Callable[[DataFrame], DataFrame], phrases: list[str]) -> DataFrame:
    """Answers (query_id, question, context, answer) with abstentions tried again, once.

    The best gated-out chunk goes in front of the context and ``generate`` maps (query_id, question,
    context) to (query_id, answer). If that abstains, too, or nothing was gated out, the first answer stays.
    """
    out = placed.where("NOT passed_gate").groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "content", "score"), "rank").alias("more"))
    again = answers.where(abstains(F.col("answer"), phrases)).join(out, "query_id")
    again = again.select("query_id", "question", F.concat_ws("\n\n", "more.content", "context").alias("context"), "more.chunk_id")
    tried = generate(again.select("query_id", "question", "context")).select("query_id", F.col("answer").alias("second"))
    second = again.select("query_id", "chunk_id").join(tried, "query_id").where(~abstains(F.col("second"), phrases))
    joined = answers.join(second, "query_id", "left")
    return joined.select("query_id", F.coalesce("second", "answer").alias("answer"), F.col("second").isNotNull().alias("retried"), F.col("chunk_id").alias("injected_chunk"))
