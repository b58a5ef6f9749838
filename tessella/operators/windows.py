"""Overlapping windows over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_starts(length: Column, budget: Column, overlap: int = 50) -> Column:
    """Starts of windows of ``budget`` tokens; the last ends at the end. None if there is no budget.

    Neighbours overlap by ``overlap`` tokens, or by half the budget if that is less.
    """
    stride = F.greatest(F.lit(1), budget - F.least(F.lit(overlap), F.floor(budget / 2).cast("int")))
    many = F.array_distinct(F.concat(F.sequence(F.lit(0), length - budget, stride), F.array(length - budget)))
    return F.when(budget <= 0, F.array().cast("array<int>")).when(length <= budget, F.array(F.lit(0))).otherwise(many)


def windows(tokens: Column, budget: Column, overlap: int = 50) -> Column:
    """The windows themselves, as arrays of tokens."""
    return F.transform(window_starts(F.size(tokens), budget, overlap), lambda s: F.slice(tokens, s + 1, budget))
