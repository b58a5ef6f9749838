"""What a retriever is, and lists of several of them over questions that are embedded once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..storage import stored
from . import bm25, dense


@runtime_checkable
class Retriever(Protocol):
    """Anything that ranks chunks for queries (query_id, question, embedding): (query_id, domain, chunk_id, score, rank)."""

    name: str

    def search(self, queries: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Sparse:
    """BM25 over an index."""

    index: bm25.Bm25Index
    config: RetrievalConfig = field(default_factory=RetrievalConfig)
    name: str = "sparse"

    def search(self, queries: DataFrame) -> DataFrame:
        return bm25.search(self.index, queries.select("query_id", "question"), self.config)


@dataclass(frozen=True)
class Dense:
    """Nearest cells of vectors, with the queries' predicates if they have any."""

    cells: DataFrame
    config: RetrievalConfig = field(default_factory=RetrievalConfig)
    name: str = "dense"

    def search(self, queries: DataFrame) -> DataFrame:
        return dense.search(self.cells, queries.select("query_id", "embedding", *(["where"] if "where" in queries.columns else [])), self.config)


def ranked(queries: DataFrame, retrievers: list[Retriever], embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The lists of all retrievers with a ``source`` column, as ``fusion.fuse`` takes them.

    ``queries`` (query_id, question) are embedded once by ``embed``, a column expression or pandas UDF, and stored for
    all of them; queries that have an ``embedding`` keep it.
    """
    if embed is not None and "embedding" not in queries.columns:
        queries = stored(queries.withColumn("embedding", embed(F.col("question"))), "embedded-queries")
    return reduce(DataFrame.unionByName, [r.search(queries).withColumn("source", F.lit(r.name)) for r in retrievers])
