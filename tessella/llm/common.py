"""Helpers shared by the corpus operators: shared storage and text classes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, spread

#: The white space of every contract here: space and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, in local sessions without it a temporary one."""
    return shared_folder(spark)


def new_name(name: str) -> str:
    """A name that nothing else has."""
    return f"{name}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{new_name(name)}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks that read it, never the work before.
    """
    path = new_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` stores within is removed at the end, when what was made of it has to be written."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def file_system(uri: str):
    """(pyarrow file system, path) for a URI in shared storage (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file so that readers see all of it or none.

    A retried or speculative task writes the same bytes, so the last rename wins harmlessly.
    """
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def exists(uri: str) -> bool:
    from pyarrow import fs as files

    fs, path = file_system(uri)
    return fs.get_file_info(path).type != files.FileType.NotFound


def list_files(uri: str, suffix: str) -> list[str]:
    """URIs of the files right in a folder, by name; none if there is no such folder."""
    from pyarrow import fs as files

    fs, path = file_system(uri)
    found = fs.get_file_info(files.FileSelector(path, allow_not_found=True))
    return sorted(f"{uri.rstrip('/')}/{f.base_name}" for f in found if f.base_name.endswith(suffix))


def keep_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``wanted`` (id, digest) names, one for each, with all their columns.

    ``digest`` is the xxhash64 of the text, null as empty. Rows that repeat id and text, of which
    one stays, are looked for in ids and digests only; texts are moved a second time only if any do.
    """
    named = wanted.select(F.col("id").alias("tessella_id"), F.col("digest").alias("tessella_digest"))
    repeated = not named.groupBy("tessella_id", "tessella_digest").count().where("count > 1").isEmpty()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("tessella_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("tessella_digest"))
    kept = docs.join(named, same, "left_semi")
    if repeated:
        kept = kept.withColumn("tessella_digest", F.xxhash64(text_or_empty(text_col))).dropDuplicates([id_col, "tessella_digest"]).drop("tessella_digest")
    return kept


def with_own_names(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` of ``docs``, for steps that keep the columns: those named like helper columns have other names meanwhile."""
    names = {c: new_name("column").replace("-", "_") for c in docs.columns if c.startswith("tessella_")}
    return step(docs.withColumnsRenamed(names)).withColumnsRenamed({own: c for c, own in names.items()})


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
