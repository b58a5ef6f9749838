"""Collections of vectors: a Parquet table beside a file of its settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import dimension

METRICS = ("cosine",)


def create_or_open(spark: SparkSession, folder: str, vectors: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """The table of the collection in ``folder``, which is written from ``vectors`` (with a column embedding) if there is none.

    Its settings, the metric and the vectors' one dimension, are stored beside it; another metric
    raises ValueError, and so do a folder without a collection and no vectors.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric is called {metric}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/settings")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if vectors is None:
            raise ValueError(f"there is no collection in {folder}")
        size = dimension(vectors)
        vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
        spark.createDataFrame([(metric, size)], "metric string, dimension int").coalesce(1).write.json(f"{folder}/settings")
    return spark.read.parquet(f"{folder}/vectors")


def settings(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, dimension) of a collection."""
    return spark.read.schema("metric string, dimension int").json(f"{folder}/settings")


def check_dimension(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """``queries`` with a column embedding; those of another dimension than the collection's raise when they are read."""
    size = settings(spark, folder).first().dimension
    return queries.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector hasn't {size} dimensions")).cast(dict(queries.dtypes)["embedding"])))
