"""Retrieval metrics of runs against ground truth, and their summaries by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pipe_list, stripped

HITS = (1, 3, 5, 10)
METRICS = [*(f"hit_{k}" for k in HITS), "rr"]


def with_question(sheet: DataFrame) -> DataFrame:
    """The first of the spellings of the question column, as ``question``."""
    for name in ("question", "Question", "query", "Query"):
        if name in sheet.columns:
            return sheet.withColumnRenamed(name, "question")
    raise ValueError("the sheet has no question column")


def join_sheets(runs: DataFrame, truths: DataFrame) -> DataFrame:
    """Runs with their ground truth by the exact question; other columns that clash get ``_run`` and ``_truth``."""
    runs, truths = with_question(runs), with_question(truths)
    clash = {c for c in runs.columns if c in truths.columns and c != "question"}
    return runs.withColumnsRenamed({c: f"{c}_run" for c in clash}).join(truths.withColumnsRenamed({c: f"{c}_truth" for c in clash}), "question")


#: Fixed names of a run sheet's columns, and what they are called here.
RUN_COLUMNS = {
    "Answer": "answer",
    "Admitted Chunk IDs (Ranked)": "admitted_chunk_ids_ranked",
    "Gated-Out Chunk IDs (Ranked)": "gated_out_chunk_ids_ranked",
    "Source Domains": "source_domains",
    "Error": "error",
    "Expected Domain": "expected_domain",
    "Expected Decision": "expected_decision",
}
#: Columns of a truth sheet that name an item's ground truth.
SOURCE_COLUMNS = [f"source_chunk_id_{k}" for k in range(1, 7)]


def renamed(runs: DataFrame) -> DataFrame:
    """Runs with the names of RUN_COLUMNS, and ``Tier`` as ``predicted_tier``; what is missing stays so."""
    return runs.withColumnsRenamed(RUN_COLUMNS | {"Tier": "predicted_tier"})


def of_tier(rows: DataFrame, tier: str, column: str = "tier") -> DataFrame:
    """The rows of exactly this tier."""
    return rows.where(F.col(column) == tier)


def truth_set(columns: list[str] = SOURCE_COLUMNS) -> Column:
    """The different ids of several columns, trimmed, without blanks."""
    return F.array_distinct(F.filter(F.array(*[stripped(F.col(c).cast("string")) for c in columns]), lambda x: x.isNotNull() & (x != "")))


def full_ranking(admitted: Column, gated_out: Column) -> Column:
    """The ids of two ``a | b`` lists, what was admitted before what was gated out."""
    return F.concat(pipe_list(admitted), pipe_list(gated_out))


def evaluable(answer: Column, admitted: Column) -> Column:
    """Whether a run has an answer that isn't blank and admitted some chunk."""
    return (stripped(F.coalesce(answer, F.lit(""))) != "") & (F.size(pipe_list(admitted)) > 0)


def list_metrics(ranking: Column, truth: Column) -> dict[str, Column]:
    """hit_k for each of HITS and rr of an array of ids against a set; null where the set is empty."""
    first = F.aggregate(ranking, F.struct(F.lit(0).alias("at"), F.lit(0).alias("first")), lambda s, x: F.struct((s["at"] + 1).alias("at"), F.when((s["first"] == 0) & F.array_contains(truth, x), s["at"] + 1).otherwise(s["first"]).alias("first")), lambda s: s["first"])
    some = F.size(truth) > 0
    hits = {f"hit_{k}": F.when(some, ((first > 0) & (first <= k)).cast("double")) for k in HITS}
    return hits | {"rr": F.when(some, F.when(first > 0, 1 / first).otherwise(0.0))}


def rank_metrics(rankings: DataFrame, truths: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: n_truth, hit_k for each of HITS, and the reciprocal rank of the first hit.

    ``rankings`` has query_id, chunk_id and position; ``truths`` query_id and chunk_id. Without
    ground truth all metrics are null; without a hit they are 0.
    """
    wanted = truths.distinct()
    first = rankings.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("position").alias("first"))
    known = wanted.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    out = queries.join(known, "query_id", "left").join(first, "query_id", "left").na.fill(0, ["n_truth"])
    some = F.col("n_truth") > 0
    hits = {f"hit_{k}": F.when(some, F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))) for k in HITS}
    return out.withColumns(hits | {"rr": F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0)))}).drop("first")


def summarise(metrics: DataFrame, slice_col: str) -> DataFrame:
    """Overall (null slice, ``level`` 1) and per slice: rows and the means of all metrics, NaN and null left out."""
    means = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in METRICS]
    grouped = metrics.groupingSets([[F.col(slice_col)], []], F.col(slice_col))
    return grouped.agg(F.grouping(slice_col).cast("int").alias("level"), F.count("*").alias("n"), *means).withColumnRenamed(slice_col, "slice")


def describe(metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """A row per metric: count, mean, sample deviation, least, exact quartiles, largest."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select("m.*").where("x IS NOT NULL AND NOT isnan(x)")
    quartiles = [F.percentile("x", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("std"), F.min("x").alias("least"), *quartiles, F.max("x").alias("largest"))


def contexts(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, contexts, n_missing) of ids (query_id, chunk_ids): the texts of chunks (chunk_id, content) in the order of the ids.

    Unknown ids are left out and counted.
    """
    each = ids.select("query_id", F.posexplode_outer("chunk_ids").alias("at", "chunk_id"))
    found = each.join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("at", "content"))))
    missing = F.count_if(F.col("chunk_id").isNotNull() & F.col("content").isNull())
    return found.groupBy("query_id").agg(F.transform(listed, lambda x: x["content"]).alias("contexts"), missing.alias("n_missing"))


def samples(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs (query_id, answer, ...) with their contexts, without blank answers and those that have no context."""
    return runs.join(found, "query_id").where((F.trim(F.coalesce("answer", F.lit(""))) != "") & (F.size("contexts") > 0))
