"""Ingestion: identifiers, metadata, and keyed upserts into a stored collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count

#: The first of these that isn't empty names a chunk's entity.
ENTITY_KEYS = ("hero", "champion", "item", "mechanics")


def chunk_id(game: Column, entities: list[Column], path: Column, index: Column) -> Column:
    """``game_entity_path_index``, with defaults for what is null or, of the entities, empty."""
    entity = F.coalesce(*[F.nullif(e, F.lit("")) for e in entities], F.lit("general"))
    return F.concat_ws("_", F.coalesce(game, F.lit("Unknown")), entity, F.coalesce(path, F.lit("unknown_path")), F.coalesce(index.cast("string"), F.lit("0")))


def sanitised(metadata: Column) -> Column:
    """A string map with lower-case keys and no nulls; of keys that differ in case the last stays."""
    entries = F.filter(F.map_entries(metadata), lambda e: e["value"].isNotNull())
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def with_token_count(metadata: Column, content: Column) -> Column:
    """A string map of metadata whose ``token_count`` is that of the text, whatever it was."""
    rest = F.map_filter(metadata, lambda k, v: k != "token_count")
    return F.map_concat(rest, F.create_map(F.lit("token_count"), token_count(content).cast("string")))


def last_of_each(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``. Rows of a key are aggregated before the shuffle, however many it has."""
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(F.col(f"`{key}`").alias("tessella_key")).agg(best.alias("tessella_row")).select("tessella_row.*")


def upsert(current: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``current`` with the rows of ``batch`` in place of those with their keys; within the batch the last one counts.

    Only keys are compared with what is stored; stored rows that stay are not sorted.
    """
    fresh = last_of_each(batch, key, [F.col(c) for c in order])
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def first_file_wins(rows: DataFrame, key: str, file_order: str, line: str) -> DataFrame:
    """Per key the last line, a number, of the first file that has it; aggregated before the shuffle."""
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(F.col(f"`{file_order}`"), -F.col(f"`{line}`")))
    return rows.groupBy(F.col(f"`{key}`").alias("tessella_key")).agg(best.alias("tessella_row")).select("tessella_row.*")
