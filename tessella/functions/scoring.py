"""Scores of pairs of texts, and where models plug in.

A scorer maps a query's and a text's tokens to a number as a column expression. The lexical ones here
are deterministic stand-ins for neural models, not reproductions of them; a model's scorer would
be a pandas UDF with the same two arguments.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class PairScorer(Protocol):
    def __call__(self, query_tokens: Column, text_tokens: Column) -> Column: ...


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    """The share of the query's different tokens that the text has; 0 for a query without any."""
    wanted = F.array_distinct(query_tokens)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, text_tokens)) / F.size(wanted)).otherwise(0.0)


def lexical_logit(query_tokens: Column, text_tokens: Column) -> Column:
    """Coverage stretched to -4 .. 4."""
    return 8 * coverage(query_tokens, text_tokens) - 4


def calibrated(raw: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-raw / temperature))


def probability(logprob: Column, floor: float = -50.0) -> Column:
    return F.when(logprob <= floor, 0.0).otherwise(F.exp(logprob))
