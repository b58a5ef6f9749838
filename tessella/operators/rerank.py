"""Scoring candidates against their query, gating, the token budget and placement in the context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RerankConfig
from ..functions.scoring import PairScorer, calibrated, lexical_logit
from ..functions.text import tokens, without_prefix
from .windows import windows


def _by_query():
    return Window.partitionBy("query_id")


def score_candidates(queries: DataFrame, candidates: DataFrame, config: RerankConfig = RerankConfig(), scorer: PairScorer = lexical_logit) -> DataFrame:
    """Candidates (query_id, chunk_id, position, content, token_count) with ``raw`` and ``score``.

    A text longer than the model's window is scored by overlapping windows, of which the best counts;
    one without any window gets minus infinity and so score 0. Candidates of a query over
    ``most_query_tokens`` are left out. Scores are rounded to 4 places, which later steps go by.
    """
    asked = queries.select("query_id", tokens(F.col("question")).alias("q")).where(F.size("q") <= config.most_query_tokens)
    budget = F.lit(config.model_window - config.special_tokens - config.safety) - F.size("q")
    # a projection for each step: Spark doesn't repeat what a later one uses more than once
    listed = candidates.withColumn("t", tokens(without_prefix(F.col("content"))))
    paired = listed.join(asked, "query_id").withColumn("parts", windows(F.col("t"), budget, config.overlap))
    raw = F.coalesce(F.array_max(F.transform("parts", lambda w: scorer(F.col("q"), w))), F.lit(float("-inf")))
    return paired.withColumn("raw", raw).withColumn("score", F.round(calibrated(F.col("raw"), config.temperature), 4)).drop("q", "t", "parts")


def gate(scored: DataFrame, config: RerankConfig = RerankConfig()) -> DataFrame:
    """Adds ``rank``, ``passed_gate`` and ``fallback``: at the threshold or above, or else the best one."""
    order = _by_query().orderBy(F.desc("score"), "position")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    fallback = F.max("score").over(_by_query()) < config.gate
    return ranked.withColumn("fallback", fallback).withColumn("passed_gate", (F.col("score") >= config.gate) | (F.col("fallback") & (F.col("rank") == 1)))


def place(gated: DataFrame, config: RerankConfig = RerankConfig(), placement: str = "recency") -> DataFrame:
    """Adds ``in_context`` and ``context_position``; what the budget cuts passed the gate, but has no position.

    Leading chunks stay while their tokens fit the budget, the first always; the first that doesn't fit
    ends the context. ``recency`` puts the best last; ``edges`` puts odd ranks last and even ranks first.
    """
    running = _by_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("passed_gate"), F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)))).over(running)
    fits = F.col("passed_gate") & ((F.col("rank") == 1) | (used <= config.context_tokens))
    chosen = gated.withColumn("in_context", fits)
    n = F.count_if("in_context").over(_by_query())
    rank = F.col("rank")
    if placement == "recency":
        at = n - rank + 1
    elif placement == "edges":
        at = F.when(rank % 2 == 1, n - F.floor((rank - 1) / 2)).otherwise(F.floor(rank / 2))
    else:
        raise ValueError(f"no placement is called {placement}")
    return chosen.withColumn("context_position", F.when(F.col("in_context"), at.cast("int")))


def admitted_statistics(queries: DataFrame, placed: DataFrame) -> DataFrame:
    """Per query, also without candidates: count, tokens and scores of the context, rows in each state."""
    inside = F.col("in_context")

    def of(f):
        return F.round(F.coalesce(f(F.when(inside, F.col("score"))), F.lit(0.0)), 4)

    found = placed.groupBy("query_id").agg(
        F.count_if(inside).alias("n_context"),
        F.count_if(F.col("passed_gate") & ~inside).alias("n_trimmed"),
        F.count_if(~F.col("passed_gate")).alias("n_gated_out"),
        F.coalesce(F.sum(F.when(inside, F.col("token_count"))), F.lit(0)).alias("context_tokens"),
        of(F.max).alias("max_score"),
        of(F.min).alias("min_score"),
        of(F.avg).alias("mean_score"),
        of(F.median).alias("median_score"),
        F.max("fallback").alias("fallback"),
    )
    zeros = {c: 0 for c in found.columns if c not in ("query_id", "fallback")}
    return queries.select("query_id").join(found, "query_id", "left").na.fill(zeros).na.fill({"fallback": False})


#: What a citation tells of its chunk, where the candidates have it.
CITED = ["context_position", "chunk_id", "domain", "score", "raw", "metadata"]


def contexts(placed: DataFrame) -> DataFrame:
    """(query_id, context, citations): the chunks' texts in order of position, a blank line between.

    A citation has the fields of CITED that ``placed`` has.
    """
    fields = [c for c in CITED if c in placed.columns]
    parts = F.array_sort(F.collect_list(F.struct("context_position", F.struct("content", *fields).alias("chunk"))), lambda a, b: a["context_position"] - b["context_position"])
    listed = placed.where("in_context").groupBy("query_id").agg(F.transform(parts, lambda p: p["chunk"]).alias("parts"))
    cited = F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in fields]))
    return listed.select("query_id", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("context"), cited.alias("citations"))


def score_report(placed: DataFrame, most: int = 5) -> DataFrame:
    """Per query the spread of ``score`` and ``raw`` over all scored candidates, candidates by domain, and
    the best ``most`` that were gated out. The median of an even number is the upper middle."""

    def middle(c: str):
        listed = F.sort_array(F.collect_list(c))
        return F.element_at(listed, (F.floor(F.size(listed) / 2) + 1).cast("int"))

    spread = {f"{f.__name__}_{c}": f(c) for c in ("score", "raw") for f in (F.max, F.min)} | {f"median_{c}": middle(c) for c in ("score", "raw")}
    outs = F.transform(F.sort_array(F.collect_list(F.when(~F.col("passed_gate"), F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"])
    totals = placed.groupBy("query_id").agg(F.count("*").alias("n_scored"), F.count_if(~F.col("passed_gate")).alias("n_gated_out"), *[c.alias(n) for n, c in spread.items()], F.slice(outs, 1, most).alias("gated_out"))
    by_domain = placed.groupBy("query_id", "domain").count().groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "count")))).alias("domains"))
    return totals.join(by_domain, "query_id")
