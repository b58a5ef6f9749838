"""Token-budgeted chunks: prefixes, word windows, greedy bundles, cuts at separators."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DATA_MARKER, token_count
from .windows import window_starts


def prefix(pairs: dict[str, Column]) -> Column:
    """``key: value | ... | Data: ``, without pairs whose value is null."""
    return F.concat(F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs.items()]), F.lit(f" {DATA_MARKER}"))


def word_chunks(docs: DataFrame, pairs: dict[str, Column], budget: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks (chunk_id, chunk_index, page_content, token_count) of docs (chunk_id, content), each within the budget with its prefix.

    Words are kept whole and parted by single spaces; a text that fits is one chunk, an empty one none.
    """
    words = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\S+"), F.lit(0))
    head = prefix(pairs)
    room = F.greatest(F.lit(2 * overlap), F.lit(budget - 2) - F.size(F.regexp_extract_all(head, F.lit(r"\S+"), F.lit(0))))
    listed = docs.withColumns({"head": head, "w": words}).where(F.size("w") > 0).withColumn("room", room)
    each = listed.select("chunk_id", "head", "w", "room", F.posexplode(window_starts(F.size("w"), F.col("room"), overlap)).alias("chunk_index", "at"))
    content = F.concat("head", F.array_join(F.slice("w", F.col("at") + 1, F.col("room")), " "))
    return each.select("chunk_id", "chunk_index", content.alias("page_content")).withColumn("token_count", token_count(F.col("page_content")))


def bundles(sizes: Column, budget: int) -> Column:
    """The bundle number of each item of an ordered array of token counts.

    Items fill a bundle while their sizes fit the budget; one that is larger by itself has its own.
    """
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("bundle"), F.lit(0).cast("int").alias("used"))

    def add(s, x):
        full = (s["used"] > 0) & (s["used"] + x > budget)
        bundle = F.when(full, s["bundle"] + 1).otherwise(s["bundle"])
        return F.struct(F.concat(s["at"], F.array(bundle)).alias("at"), bundle.alias("bundle"), F.when(full, x).otherwise(s["used"] + x).cast("int").alias("used"))

    return F.aggregate(sizes, start, add, lambda s: s["at"])


#: Where a long text is cut: at the first of these that it has, else between characters.
SEPARATORS = ("\n\n", "\n", "},", '",', ". ", " ", "")
_TOKEN, _POSSESSIVE = re.compile("[a-z0-9]+"), re.compile(r"'s\b", re.ASCII)


def count_tokens(text: str) -> int:
    """As ``functions.text.token_count``, for one text."""
    return len(_TOKEN.findall(_POSSESSIVE.sub("", text.lower())))


def _joined(pieces: list[str], budget: int, overlap: int) -> Iterator[str]:
    """Pieces put together up to the budget; each part begins with the last pieces of the one before, up to the overlap."""
    held, used = deque(), 0
    for piece in pieces:
        size = count_tokens(piece)
        if held and used + size > budget:
            yield "".join(p for p, _ in held)
            while held and (used > overlap or used + size > budget):
                used -= held.popleft()[1]
        held.append((piece, size))
        used += size
    if held:
        yield "".join(p for p, _ in held)


def split_text(text: str, budget: int, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of a text within a budget of tokens, cut as coarsely as possible, stripped and not empty.

    A separator stays with what follows it. A piece that doesn't fit is cut by the separators that
    come after; one of a single character that doesn't fit stays as it is.
    """
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    pieces = re.split(f"(?={re.escape(separator)})", text) if separator else list(text)
    out, fitting = [], []
    for piece in filter(None, pieces):
        if count_tokens(piece) < budget:
            fitting.append(piece)
            continue
        out += _joined(fitting, budget, overlap)
        fitting = []
        out += split_text(piece, budget, overlap, finer) if finer else [piece]
    out += _joined(fitting, budget, overlap)
    return [p for p in map(str.strip, out) if p]


def recursive_chunks(docs: DataFrame, pairs: dict[str, Column], budget: int = 512, overlap: int = 50) -> DataFrame:
    """As ``word_chunks``, but cut at separators: (chunk_id, chunk_index, page_content, token_count).

    A text that fits behind its prefix is one chunk, an empty one too.
    """
    id_type = docs.schema["chunk_id"].dataType.simpleString()
    head = prefix(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, parts = [], [], []
            for row, (text, room) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = split_text(text, room, overlap) if count_tokens(text) > room else [text]
                rows += [row] * len(found)
                index += range(len(found))
                parts += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(3).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(parts, pa.string())], ["chunk_id", "head", "chunk_index", "part"])

    listed = docs.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), F.greatest(F.lit(2 * overlap), F.lit(budget - 2) - token_count(head)).alias("room"), head.alias("head"))
    each = listed.mapInArrow(cut, f"chunk_id {id_type}, head string, chunk_index int, part string")
    return each.select("chunk_id", "chunk_index", F.concat("head", "part").alias("page_content")).withColumn("token_count", token_count(F.col("page_content")))
