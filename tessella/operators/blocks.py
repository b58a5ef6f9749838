"""Blocks of rows and blocks of queries: what meets whom is decided by bounds of whole blocks.

An index is a table of blocks, each with some rows of one domain. A search streams through them
beside stored blocks of queries; a block whose bound for a query is below that query's k-th best score so
far isn't scored. Only the best of each batch are passed on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Queries of a block; rows of an index block; rows that are cut into blocks together, and their bytes at most.
BLOCK, ROWS, BUFFER, BUFFER_BYTES = 512, 16, 16_384, 1 << 22
#: Index blocks are wide rows, and a reader decodes up to 4096 rows of a row group at once; so row groups are small.
NARROW = {"parquet.block.size": str(1 << 22)}
#: Files of queries up to which a task holds the best rows of all that it reads; with more it passes on those of each piece.
HELD_FILES = 8
#: Scores are compared after rounding to 9 places; bounds leave room for that.
SLACK = 1e-8


def query_blocks(queries: DataFrame, name: str, block: int = BLOCK) -> list[str]:
    """Store ``queries`` (query_id, ...) in files that hold all rows of about ``block`` queries each.

    Only the files' names come to the driver; the rows go from table to tasks.
    """
    number = queries.agg(F.count_distinct("query_id")).first()[0]
    return sorted(stored(queries.repartition(max(1, -(-number // block)), "query_id"), name).inputFiles())


@lru_cache(maxsize=2)
def read_block(uri: str) -> pa.Table:
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=files, partitioning=None).combine_chunks()


def buffered(batches, rows: int, size: int = BUFFER_BYTES):
    """Record batches put together, and larger ones cut, to pieces of about ``rows`` rows or ``size`` bytes, whichever comes first."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        each = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, each):
            held.append(batch.slice(at, each))
            if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
                yield _merged(held)
                held = []
    if held:
        yield _merged(held)


def _merged(held: list[pa.RecordBatch]) -> pa.Table:
    """One table of its own memory, whose lists begin at 0."""
    columns = [pa.concat_arrays([b.column(c) for b in held]) for c in range(held[0].num_columns)]
    return pa.Table.from_arrays(columns, schema=held[0].schema)


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A combined table's column as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def codes(values: pa.Array) -> np.ndarray:
    """Numbers of the values in their order; nulls come last."""
    return pc.rank(values, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def listed(flat: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    """Consecutive slices of ``flat``, which end at ``ends``, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), flat if isinstance(flat, pa.Array) else pa.array(flat))


class Best:
    """The best scores of some queries so far, and the rows that have them."""

    def __init__(self, queries: int, k: int):
        self.top, self.found = np.full((queries, k), -np.inf), []

    def floor(self) -> np.ndarray:
        return self.top[:, 0] - SLACK

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores (a row per id, a column per query); those of -inf are none."""
        k = self.top.shape[1]
        both = np.concatenate([self.top[queries], scores.T], axis=1)
        self.top[queries] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        self.top[queries] = np.sort(self.top[queries], axis=1)
        column, row = np.nonzero((scores >= self.floor()[queries]).T & np.isfinite(scores.T))
        self.found.append((queries[column], ids.take(pa.array(row)), scores[row, column]))

    def settle(self) -> None:
        """Forget what can't be among the best any more."""
        if self.found:
            self.found = [self.rows()]

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        """(query, id, score) of all that may be among the best."""
        if not self.found:
            return None
        query, score = (np.concatenate([f[i] for f in self.found]) for i in (0, 2))
        keep = np.flatnonzero(score >= self.floor()[query])
        return query[keep], pa.concat_arrays([f[1] for f in self.found]).take(pa.array(keep)), score[keep]


def as_batch(query_ids: pa.Array, domain: str | None, rows: tuple) -> pa.RecordBatch:
    query, ids, score = rows
    columns = [query_ids.take(pa.array(query)), pa.array([domain] * len(query), pa.string()), ids, pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "domain", "chunk_id", "score"])


def count_batch(scored: int, pairs: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([scored], pa.int64()), pa.array([pairs], pa.int64())], ["scored", "pairs"])
