"""Micro-batches that upsert into a Parquet collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import last_of_each, upsert
from ..sources.buckets import BucketedTable


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], partitions: int | None = None) -> StreamingQuery:
    """Run what is there of ``stream`` and keep the last row of each key in versioned tables under ``folder``.

    Version n holds the collection after batch n; a batch that is tried again writes its version again.
    """
    from pyspark.sql import functions as F

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            out = upsert(spark.read.parquet(f"{folder}/version={number - 1}"), batch, key, order)
        else:
            out = last_of_each(batch, key, [F.col(c) for c in order])
        (out.repartition(partitions) if partitions else out).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed_stream(stream: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Run what is there of ``stream`` into a bucketed table, of which each batch rewrites only the buckets it has keys of."""
    return stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
