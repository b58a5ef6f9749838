"""Balanced blocks of a text, nested as deep as they come, as column expressions: a fold over delimiters that carries the depth."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEGMENTS = "array<struct<kind:string,text:string>>"


def segments(text: Column, head: str, opening: str = "{{", closing: str = "}}") -> Column:
    """The text in order as structs: ``block`` from an opening that ``head`` (a regular expression) follows to
    its closing, ``open`` from one that is never closed to the end, and ``plain`` for all between. A null text gives null.

    Blocks within a block are part of it.
    """
    own = "".join(f"\\x{ord(c):02x}" for c in sorted(set(opening + closing)))
    delimiters = [re.escape(x) for x in (opening, closing)]
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){delimiters[0]}|{delimiters[1]}|[^{own}]+|[{own}]"), F.lit(0))
    following = F.concat(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), F.array(F.lit("")))
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("current"), F.array().cast(_SEGMENTS).alias("done"))

    def segment(kind: str, c: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), c.alias("text")))

    def step(state: Column, x: Column) -> Column:
        piece, outside = x["piece"], state["depth"] == 0
        starts = outside & (piece == opening) & x["next"].rlike(f"^(?:{head})")
        depth = F.when(outside, F.when(starts, 1).otherwise(0)).when(piece == opening, state["depth"] + 1).when(piece == closing, state["depth"] - 1).otherwise(state["depth"])
        current = F.when(outside & ~starts, "").otherwise(F.concat(state["current"], piece))
        ended = ~outside & (depth == 0)
        done = F.when(outside & ~starts, F.concat(state["done"], segment("plain", piece))).when(ended, F.concat(state["done"], segment("block", current))).otherwise(state["done"])
        return F.struct(depth.cast("int").alias("depth"), F.when(ended, "").otherwise(current).alias("current"), done.cast(_SEGMENTS).alias("done"))

    zipped = F.arrays_zip(pieces.alias("piece"), following.alias("next"))
    return F.aggregate(zipped, begin, step, lambda s: F.when(s["depth"] == 0, s["done"]).otherwise(F.concat(s["done"], segment("open", s["current"]))))


def texts(found: Column, kind: str) -> Column:
    return F.transform(F.filter(found, lambda x: x["kind"] == kind), lambda x: x["text"])


def blocks(text: Column, head: str, opening: str = "{{", closing: str = "}}") -> Column:
    """The closed blocks of a text that ``head`` begins."""
    return texts(segments(text, head, opening, closing), "block")


def without(text: Column, head: str, opening: str = "(", closing: str = ")") -> Column:
    """The text without such blocks, and without what follows one that is never closed."""
    return F.array_join(texts(segments(text, head, opening, closing), "plain"), "")
