"""Run sheets and question sheets as CSV with a header, and records as JSON files (spreadsheets are saved as CSV first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quotes are doubled and cells may hold line ends, as spreadsheets write them.
OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; empty cells are null."""
    return spark.read.options(**OPTIONS).csv(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def file_name(name: Column) -> Column:
    """Lower case with underscores for blanks and no apostrophes."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def write_records(records: DataFrame, name: str, path: str) -> None:
    """JSON lines in one folder per record, named by a column; nulls are written out."""
    named = records.withColumn("record", file_name(F.col(name)))
    named.write.mode("overwrite").partitionBy("record").option("ignoreNullFields", False).json(path)


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, json, error): whole files; what isn't JSON has its start as error and no json."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    broken = F.try_parse_json("value").isNull()
    return whole.select("file", F.when(~broken, F.col("value")).alias("json"), F.when(broken, F.substring("value", 1, 200)).alias("error"))
