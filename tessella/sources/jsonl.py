"""JSON-lines sources and sinks: chunks with a schema, and tolerant scans that keep what is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import ENTITY_KEYS, chunk_id
from ..storage import small, stored

CHUNK_SCHEMA = "page_content string, metadata map<string, string>, token_count int"


def read_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chunks of one or many JSONL files or patterns; blank lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).json(paths)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, line_no from 1, line) of text files, blank lines included.

    Files are read in splits. The lines of each are counted first; then a line's number is its place in
    its split and the lines of the file's splits before it, added where the line is read: lines aren't shuffled.
    Files of one name in several folders keep apart by their path.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counts = read.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    starts = small(stored(counts.select("path", "block", (before - F.col("first") + 1).alias("start")), "splits"))
    return read.join(starts, ["path", "block"]).select("path", "file", (F.col("at") + F.col("start")).alias("line_no"), "line")


def scan_tolerant(lines: DataFrame, snippet: int = 200) -> DataFrame:
    """Lines with ``json`` (variant), or ``error`` with the start of a line that isn't JSON. Blank lines are left out."""
    parsed = lines.where(F.trim("line") != "").withColumn("json", F.try_parse_json("line"))
    return parsed.withColumn("error", F.when(F.col("json").isNull(), F.substring("line", 1, snippet)))


def first_field(line: Column, names: list[str]) -> Column:
    """The first of several fields of a JSON line that is there."""
    return F.coalesce(*[F.get_json_object(line, f"$.{n}") for n in names])


#: Fixed names of a chunk's id, of its text, and of the object that may hold the id, in the order in which they count.
ID_FIELDS = ["chunk_id", "id", "_id"]
TEXT_FIELDS = ["text", "content", "page_content", "chunk_text", "passage"]
METADATA_FIELDS = ["metadata", "meta"]


def _has(keys: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def _first_of(line: Column, keys: Column, names: list[str], at: str = "$") -> tuple[Column, Column]:
    """(whether an object at a path of ``line`` has one of several ``names``, the value of the first that it has, even if that is null).

    ``keys`` are the object's. A line is parsed for the one value only, as the branches of a CASE are.
    """
    there, value = F.lit(False), F.lit(None).cast("string")
    for name in reversed(names):
        there, value = there | _has(keys, name), F.when(_has(keys, name), F.get_json_object(line, f"{at}.{name}")).otherwise(value)
    return there, value


def resolved(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) with the ``chunk_id`` and ``content`` of their object; null where there is none.

    The id is a field of the object, else of its metadata, else put together from the metadata as
    ``ingest.chunk_id`` does, if that names a game. A line is read for its keys once, then only for what these say is there.
    """
    line, keys = F.col("line"), F.col("tessella_keys")
    read = lines.where(F.trim("line") != "").withColumn("tessella_keys", F.json_object_keys(line))
    own, own_id = _first_of(line, keys, ID_FIELDS)
    # keys of the objects that may hold the id, where it isn't in the line's own
    of = {m: F.when(_has(keys, m) & ~own, F.json_object_keys(F.get_json_object(line, f"$.{m}"))) for m in METADATA_FIELDS}
    told = read.withColumn("tessella_of", F.struct(*[k.alias(m) for m, k in of.items()]))

    def meta(name: str) -> Column:
        return F.coalesce(*[F.when(_has(keys, m), F.get_json_object(line, f"$.{m}.{name}")) for m in METADATA_FIELDS])

    made = F.when(meta("game").isNotNull(), chunk_id(meta("game"), [meta(k) for k in ENTITY_KEYS], meta("full_path"), meta("chunk_index")))
    for m in reversed(METADATA_FIELDS):
        there, value = _first_of(line, F.col(f"tessella_of.{m}"), ID_FIELDS, f"$.{m}")
        made = F.when(there, value).otherwise(made)
    identified = told.withColumns({"chunk_id": F.when(own, own_id).otherwise(made), "content": _first_of(line, keys, TEXT_FIELDS)[1]})
    return identified.drop("tessella_keys", "tessella_of")


def chunk_texts(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(file, chunk_id, content) of lines (file, line_no, line; path, if it is known); of one id the last line of a file counts.

    With paths, files of one name in several folders keep apart, and their paths are in the result. Lines without id or text are left out. With ``strict`` a file's first line, unless blank, has to have both,
    or ValueError is raised with the file's name.
    """
    bad = F.col("chunk_id").isNull() | F.col("content").isNull()
    if strict and (first := resolved(lines.where("line_no = 1")).where(bad).select("file").first()):
        raise ValueError(f"the first line of {first.file} has no id or no text")
    of_file = ["path", "file"] if "path" in lines.columns else ["file"]
    # an array of one or none: a filter would be moved before the parsing, which then would be done for it as well
    whole = F.when(~bad, F.array(F.struct("chunk_id", "content")))
    found = resolved(lines).select(*of_file, "line_no", F.explode(whole).alias("x")).select(*of_file, "line_no", "x.*")
    return found.groupBy(*of_file, "chunk_id").agg(F.max_by("content", "line_no").alias("content"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)
