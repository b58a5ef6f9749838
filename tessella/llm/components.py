"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to one row (node, component) per node of an edge.

    ``component`` is the smallest node that can be reached. Self loops and repeated edges are
    allowed; an empty edge table gives an empty result. Every round joins the larger neighbours of
    a node, and then the smaller ones, to the smallest of them, so that the edge count never grows
    and the rounds grow with the logarithm of a component's size. The minima are aggregated
    before the shuffle and stored, which leaves plain shuffled joins whose hot nodes adaptive
    execution splits; none of them is broadcast, as the driver would have to hold it.
    """
    a, b = F.col("a"), F.col("b")
    kept = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _digest(kept)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = kept.select("u", "v").unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialise(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        rest = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = materialise(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _digest(kept)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
