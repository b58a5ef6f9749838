"""Tables that are written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of wide rows.
PIECE = 1 << 21

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tessella-"))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` under a new name, with the writer's ``options``, and read it back; later uses don't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_pieces(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``stored``, while Python gets its rows in Arrow batches of PIECE bytes at most: Spark, Arrow and Python each hold some for every task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(PIECE))
    try:
        return stored(df, name, **options)
    finally:
        conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its scan has fewer partitions than there are, which only small tables have; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has no more than ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
