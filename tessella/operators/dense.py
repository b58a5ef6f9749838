"""Vectors: normalising, checking, exact nearest neighbours from cells, with predicates of each query.

A cell has some vectors of one domain about a centre, and the largest angle to it. By the triangle
inequality of angles no vector of it is nearer to a query than the query's angle to the centre less that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..storage import stored_in_pieces
from .blocks import BLOCK, BUFFER, HELD_FILES, NARROW, ROWS, Best, as_batch, buffered, codes, count_batch, listed, query_blocks, read_block, whole
from .bm25 import top_k

#: Rounds of moving centres to the means of their cells.
_ROUNDS = 3


def normalised(vector: Column) -> Column:
    """The vector at length 1, in doubles; a zero vector stays."""
    doubles = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(doubles, lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The one length of all vectors, None if there are none; several lengths raise ValueError."""
    row = vectors.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if row.low != row.high:
        raise ValueError(f"vectors of {row.low} to {row.high} dimensions")
    return row.low


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1) if len(lists) else np.empty((0, 1))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _cells(v: np.ndarray) -> list[np.ndarray]:
    """Rows of about ROWS vectors each that are near each other."""
    if len(v) <= ROWS:
        return [np.arange(len(v))]
    centres = v[:: max(1, ROWS)][: len(v)]
    for _ in range(_ROUNDS):
        nearest = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        lengths = np.linalg.norm(sums, axis=1)
        centres = np.where(lengths[:, None] > 0, sums / np.where(lengths > 0, lengths, 1)[:, None], centres)
    order = np.argsort(nearest, kind="stable")
    cut = np.flatnonzero(np.diff(nearest[order])) + 1
    return [part for cell in np.split(order, cut) for part in np.split(cell, range(4 * ROWS, len(cell), 4 * ROWS))]


def cell_index(vectors: DataFrame) -> DataFrame:
    """One row per cell of vectors (chunk_id, domain, embedding; metadata, a string map, if there is one), cut where they are read.

    ``v`` has the normalised vectors one after another. A null vector is left out; a null domain is one of its own.
    """
    has = "metadata" in vectors.columns
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    rows = vectors.where("embedding IS NOT NULL").select("chunk_id", "domain", normalised(F.col("embedding")).alias("v"), *(["metadata"] if has else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buffered(batches, BUFFER):
            ids, domain, v = whole(table.column(0)), whole(table.column(1)), _matrix(whole(table.column(2)))
            group, order, sizes, centres, radii, first = codes(domain), [], [], [], [], []
            for name in np.unique(group):
                here = np.flatnonzero(group == name)
                for cell in _cells(v[here]):
                    rows = here[cell]
                    centre = v[rows].sum(axis=0)
                    centre = centre / (np.linalg.norm(centre) or 1)
                    order.append(rows)
                    sizes.append(len(rows))
                    centres.append(centre)
                    near = _angles(v[rows] @ centre)
                    radii.append(float(near.max()) if np.linalg.norm(centre) else np.pi)
                    first.append(rows[0])
            order, ends = np.concatenate(order), np.cumsum(sizes)
            width = v.shape[1]
            columns = [domain.take(pa.array(first)), listed(ids.take(pa.array(order)), ends), listed(v[order].ravel(), ends * width), listed(np.concatenate(centres), np.arange(1, len(ends) + 1) * width), pa.array(radii)]
            if has:
                columns.append(listed(whole(table.column(3)).take(pa.array(order)), ends))
            yield pa.RecordBatch.from_arrays(columns, ["domain", "chunk_ids", "v", "centre", "radius", *(["metadata"] if has else [])])

    extra = ", metadata array<map<string,string>>" if has else ""
    return rows.mapInArrow(cut, f"domain string, chunk_ids array<{id_type}>, v array<double>, centre array<double>, radius double{extra}")


@lru_cache(maxsize=2)
def _block(uri: str) -> tuple[pa.Array, np.ndarray, np.ndarray, list[dict]]:
    """(ids, vectors, number of each query's predicates, the different predicates) of a block's queries."""
    rows = read_block(uri)
    wanted = [tuple(sorted(map(tuple, x))) for x in rows["wanted"].to_pylist()]
    different = list(dict.fromkeys(wanted))
    return whole(rows["query_id"]), _matrix(whole(rows["v"])), np.array([different.index(w) for w in wanted], np.int64), [dict(w) for w in different]


def _searched(cells: DataFrame, queries: DataFrame, config: RetrievalConfig, block: int, schema: str, counting: bool) -> DataFrame:
    k, has = config.per_source, "metadata" in cells.columns
    given = F.col("where") if "where" in queries.columns else F.create_map().cast("map<string,string>")
    wanted = F.coalesce(F.map_entries(given), F.array().cast("array<struct<key:string,value:string>>"))
    asked = queries.where("embedding IS NOT NULL").select("query_id", normalised(F.col("embedding")).alias("v"), F.transform(wanted, lambda e: F.array(e["key"], e["value"])).alias("wanted"))
    files = query_blocks(asked, "query-vectors", block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str | None, Best]] = {}
        for table in buffered(batches, BUFFER // ROWS):
            domain, radius = table.column(0).to_pylist(), table.column(4).to_numpy()
            ids, flat, centre = (whole(table.column(c)) for c in (1, 2, 3))
            for file in files:
                query_ids, q, number, predicates = _block(file)
                if not len(query_ids):
                    continue
                held, scored, pairs = kept.setdefault(file, {}) if len(files) <= HELD_FILES else {}, 0, 0
                plain = [not p for p in predicates]
                limit = np.cos(np.maximum(0, _angles(_matrix(centre) @ q.T) - radius[:, None])) + 1e-9
                for i in np.argsort(-limit.max(axis=1), kind="stable"):
                    top = held.setdefault(domain[i], Best(len(q), k))
                    count = len(ids[i])
                    pairs += count * len(q)
                    active = np.flatnonzero(limit[i] >= top.floor())
                    if not len(active):
                        continue
                    fits = None
                    if not all(plain):
                        held_by = [dict(m or ()) for m in table.column(5)[i].as_py()] if has else [{}] * count
                        fits = np.array([[all(m.get(key) == value and value is not None for key, value in p.items()) for p in predicates] for m in held_by])
                        active = active[fits.any(axis=0)[number[active]]]
                        if not len(active):
                            continue
                    scores = flat[i].values.to_numpy().reshape(count, -1) @ q[active].T
                    if fits is not None:
                        scores = np.where(fits[:, number[active]], scores, -np.inf)
                    scored += scores.size
                    top.add(active, scores, ids[i].values)
                if counting:
                    yield count_batch(scored, pairs)
                elif file in kept:
                    for top in held.values():
                        top.settle()
                else:
                    yield from (as_batch(query_ids, name, rows) for name, top in held.items() if (rows := top.rows()))
        if not counting:
            for file, held in kept.items():
                yield from (as_batch(_block(file)[0], name, rows) for name, top in held.items() if (rows := top.rows()))

    return cells.mapInArrow(best, schema)


def search(vectors: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), block: int = BLOCK) -> DataFrame:
    """(query_id, domain, chunk_id, score, rank): exact cosine top k of ``queries`` (query_id, embedding; where, if there is one).

    ``vectors`` has chunk_id, domain, embedding and, if asked for, metadata; or it is a stored table of
    ``cell_index``. ``where`` is a string map: only chunks whose metadata has all its entries are ranked, so
    the cut comes after the predicate. A null or empty map asks for nothing; a null value is never met, nor
    is anything where there is no metadata. A null vector has no neighbours and is none. Ids are of any type; ties go by chunk_id.
    """
    cells = vectors if "chunk_ids" in vectors.columns else stored_in_pieces(cell_index(vectors), "cells", **NARROW)
    types = [cells.schema["chunk_ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    found = _searched(cells, queries, config, block, f"query_id {types[1]}, domain string, chunk_id {types[0]}, score double", False)
    return top_k(stored_in_pieces(found, "dense-found"), config.per_source)


def scored_pairs(cells: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> tuple[int, int]:
    """(pairs of query and vector that a search scores, all pairs) of a table of ``cell_index``."""
    row = _searched(cells, queries, config, BLOCK, "scored long, pairs long", True).agg(F.sum("scored"), F.sum("pairs")).first()
    return row[0] or 0, row[1] or 0
