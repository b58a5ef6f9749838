"""A keyed table in buckets of hashed keys: a batch rewrites only the buckets that it has keys of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import last_of_each, upsert


class BucketedTable:
    """The last row of each key under ``folder``: ``data/batch=n/bucket=k`` has what batch n wrote, ``manifests/n`` which batch has each bucket's rows.

    A batch is there once its manifest is: readers take the last one, whatever else has been written. A
    batch that is tried again starts from the manifest before it and writes its own again, so that it
    changes nothing. Batches are numbered from 0, one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """The batches with a whole manifest, in order."""
        path, files = self._path("manifests")
        names = [int(x.getPath().getName()) for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in names if files.exists(self._path(f"manifests/{n}/_SUCCESS")[0]))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """{bucket: the batch that wrote it last}: as many entries as there are buckets at most."""
        known = [n for n in self.committed() if before is None or n < before]
        if not known:
            return {}
        return {r.bucket: r.batch for r in self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/manifests/{known[-1]}").collect()}

    def _rows(self, places: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/batch={n}/bucket={k}" for k, n in sorted(places.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The table as the last committed batch left it; None before the first row."""
        return self._rows(self.manifest())

    def apply(self, batch: DataFrame, number: int) -> None:
        """Upsert a batch; within it the last row of a key by ``order`` counts. Null keys are one key."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = last_of_each(batch, self.key, [F.col(c) for c in self.order]).persist()
        try:
            touched = [r.bucket for r in fresh.select(bucket.alias("bucket")).distinct().collect()]
            places = self.manifest(before=number)
            old = self._rows({k: places[k] for k in touched if k in places})
            out = fresh if old is None else upsert(old.select(fresh.columns), fresh, self.key, self.order)
            target = f"{self.folder}/data/batch={number}"
            out.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            listed = [(k, n) for k, n in (places | dict.fromkeys(touched, number)).items()]
            self.spark.createDataFrame(listed, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{number}")
        finally:
            fresh.unpersist()

    def vacuum(self, keep: int = 2) -> int:
        """Remove buckets and manifests that none of the last ``keep`` manifests names; how many buckets went."""
        known, removed = self.committed(), 0
        used = {(n, k) for m in known[-keep:] for k, n in self.manifest(before=m + 1).items()}
        data, files = self._path("data")
        for batch in files.listStatus(data) if files.exists(data) else []:
            number = int(batch.getPath().getName().removeprefix("batch="))
            for place in files.listStatus(batch.getPath()) if known and number <= known[-1] else []:
                name = place.getPath().getName()
                if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in used:
                    files.delete(place.getPath(), True)
                    removed += 1
        for n in known[:-keep]:
            files.delete(self._path(f"manifests/{n}")[0], True)
        return removed
