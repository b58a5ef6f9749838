"""A folder of record files to chunks: a file source with a log of what it has read, and a table of what it could not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import nodes


def ingest_folder(spark: SparkSession, folder: str, out: str, pattern: str = "*.json", budget: int = 480) -> StreamingQuery:
    """Run over the files of ``folder`` that no earlier run has read; chunks go to ``out/chunks``, broken files to ``out/rejects``.

    A file is one JSON record, which ``nodes.dispatch`` turns into chunks; its name, without the
    ending, stands in for a missing name. A file that isn't a JSON object stops nothing: it is listed by path with
    the start of its text. The source's log under ``out/log`` has what was read; a batch that is tried again
    overwrites its own output. An empty folder gives nothing.
    """
    read = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    files = read.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("record_id"), F.col("value").alias("json"))

    def apply(batch: DataFrame, number: int) -> None:
        fields = F.from_json("json", "map<string,string>")
        told = batch.withColumn("good", F.coalesce(F.try_parse_json("json").isNotNull() & F.ltrim("json").startswith("{") & fields.isNotNull(), F.lit(False))).persist()
        try:
            rejects = told.where("NOT good").select("path", F.substring("json", 1, 200).alias("start"))
            rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
            found = nodes.dispatch(nodes.top_nodes(told.where("good").select("record_id", "json")), budget)
            found.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        finally:
            told.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """(record_id, name, primary_node, sub_node, chunk_index, text, batch) of all runs."""
    return spark.read.parquet(f"{out}/chunks")


def rejects(spark: SparkSession, out: str) -> DataFrame:
    """(path, start, batch) of the files that could not be read."""
    return spark.read.parquet(f"{out}/rejects")
