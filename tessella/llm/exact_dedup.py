"""Exact duplicates by content-defined chunk recipes, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialise, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SHORTEST, LONGEST = 512, 4096


def _boundary_class(residue: int) -> str:
    """A character class of the code points U+0021 to U+024F that leave ``residue`` modulo 8."""
    return "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x250) if c % 8 == residue) + "]"


#: A chunk ends with the first two characters of these classes behind SHORTEST others, else at LONGEST.
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?{_boundary_class(1)}{_boundary_class(4)}|.{{1,{LONGEST}}}"


def content_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.replace(text_or_empty(text), F.lit(" "), F.lit("")), SPACE, "")


def chunks(text: Column) -> Column:
    """The normalised text cut where its own characters say so; no chunks for an empty text.

    The cuts depend on what stands before them in the text only, so equal texts have equal chunks,
    and long passages that texts share mostly fall into shared chunks.
    """
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def shared_hashes(different: DataFrame) -> DataFrame:
    """The hashes that belong to two or more of the different chunks (h, chunk); normally none.

    Every distinct chunk is moved once, to where equal hashes meet; then only hashes are counted.
    A chunk whose hash isn't in the result is identified by it.
    """
    return materialise(different.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared-hashes")


def ordinals(different: DataFrame, shared: DataFrame) -> DataFrame:
    """(h, chunk, ordinal): the numbers that tell chunks of a shared hash apart."""
    rivals = different.join(shared, "h").groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    return rivals.select("h", F.posexplode("all").alias("ordinal", "chunk"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, length (code points), digest, keep, size, kept, sha256.

    Texts are equal if they are identical without white space; null is the empty text, and all
    blank texts are equal. Of a group the row with the longest original text stays, then the
    smallest id, nulls last. Rows that repeat an id at the same length share that id's decision.
    ``digest`` is the xxhash64 of the original text. Other columns are not read; an empty table gives an empty result. ``hashed`` names chunks; a
    hash that two chunks share is told apart by comparing the chunks.
    """
    text = docs.select(F.col(id_col).alias("id"), F.length(text_or_empty(text_col)).cast("long").alias("length"), F.xxhash64(text_or_empty(text_col)).alias("digest"), normalised(F.col(text_col)).alias("norm"))
    cut = text.select("id", "length", "digest", F.sha2("norm", 256).alias("sha256"), chunks(F.col("norm")).alias("chunks"))
    different = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = shared_hashes(different)
    names = F.transform("chunks", lambda c: hashed(c))
    if shared.isEmpty():
        recipes = cut.select("id", "length", "digest", "sha256", names.alias("recipe"))
    else:
        found = cut.select("sha256", F.posexplode("chunks").alias("at", "chunk")).distinct().withColumn("h", hashed(F.col("chunk")))
        found = found.join(ordinals(different, shared), ["h", "chunk"]).groupBy("sha256").agg(F.map_from_entries(F.collect_list(F.struct("at", "ordinal"))).alias("ordinals"))
        named = F.transform("chunks", lambda c, i: F.concat_ws(":", hashed(c).cast("string"), F.coalesce(F.try_element_at(F.col("ordinals"), i), F.lit(0)).cast("string")))
        recipes = cut.join(found, "sha256", "left").select("id", "length", "digest", "sha256", named.alias("recipe"))
    recipes = materialise(recipes, "recipes")
    best = F.min(F.struct((-F.col("length")).alias("shorter"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = materialise(recipes.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("size")), "groups")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("length") == -F.col("best.shorter"))
    return recipes.join(groups, "recipe").select("id", "length", "digest", F.col("best.id").alias("keep"), "size", kept.alias("kept"), "sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Where rows that repeat an id at the same length are tied, one with the smallest digest stays.
    """
    kept = materialise(exact_duplicates(docs, id_col, text_col).where("kept").select("id", "digest", "sha256"), "kept")
    tied = not kept.groupBy("sha256").count().where("count > 1").isEmpty()
    if tied:
        least = kept.groupBy("sha256").agg(F.min("digest").alias("least"))
        kept = kept.join(least, "sha256").where("digest = least")
    return keep_rows(docs, kept.select("id", "digest"), id_col, text_col)
