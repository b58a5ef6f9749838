"""Line numbers, bucketed upserts and streams of them."""

import os

from pyspark.sql import functions as F

from tessella.operators import ingest
from tessella.sources import buckets, jsonl
from tessella.storage import small
from tessella.streaming.upserts import bucketed_stream


def files_of(folder):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    kept = buckets.BucketedTable(spark, f"{tmp_path}/t", "k", ["n"], buckets=8)
    assert kept.read() is None
    schema = "k string, v string, n long"
    kept.apply(spark.createDataFrame([(f"k{i}", "old", i) for i in range(100)] + [(None, "null", 0)], schema), 0)
    before = files_of(f"{tmp_path}/t/data")
    fresh = [("k1", "lost", 1), ("k1", "new", 2), ("k500", "added", 1)]
    kept.apply(spark.createDataFrame(fresh, schema), 1)
    expected = {f"k{i}": "old" for i in range(100)} | {"k1": "new", "k500": "added", None: "null"}
    rows = lambda: {r.k: r.v for r in kept.read().collect()}
    assert rows() == expected and kept.read().count() == len(expected)
    after = files_of(f"{tmp_path}/t/data")
    assert all(after[f] == t for f, t in before.items()) and len({f.split("bucket=")[1][0] for f in after if "batch=1" in f}) <= 2
    kept.apply(spark.createDataFrame(fresh, schema), 1)  # tried again
    assert rows() == expected and kept.committed() == [0, 1]
    os.remove(f"{tmp_path}/t/manifests/1/_SUCCESS")  # a batch that never got as far
    assert rows()["k1"] == "old"
    kept.apply(spark.createDataFrame(fresh, schema), 1)
    kept.apply(spark.createDataFrame([], schema), 2)
    assert rows() == expected
    assert kept.vacuum(keep=1) == len({f.split("bucket=")[1][0] for f in files_of(f"{tmp_path}/t/data") if "batch=1" in f}) and rows() == expected and kept.committed() == [2]


def test_a_stream_into_buckets(spark, tmp_path):
    kept = buckets.BucketedTable(spark, f"{tmp_path}/t", "k", ["n"], buckets=4)
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (2, "d", 1)]):
        spark.createDataFrame(rows, "k long, v string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        bucketed_stream(spark.readStream.schema("k long, v string, n long").parquet(f"{tmp_path}/in"), kept, f"{tmp_path}/checkpoint").awaitTermination(90)
    assert sorted(map(tuple, kept.read().collect())) == [(1, "a", 1), (2, "c", 2)]


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.txt").write_text("\n".join(f"{name}{k}" if k % 7 else "" for k in range(1, 3000)))
    (tmp_path / "in" / "x" / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        lines = jsonl.read_lines(spark, f"{tmp_path}/in/*")
        plan = lines._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.path.split("/")[-2], r.line_no, r.line) for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(name, k, f"{name}{k}" if k % 7 else "") for name in ("x", "y") for k in range(1, 3000)]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    texts = lines.withColumn("line", F.concat(F.lit('{"id": "same", "text": "'), "line", F.lit('"}')))
    assert sorted((r.path.split("/")[-2], r.content) for r in jsonl.chunk_texts(texts).collect()) == [("x", "x2999"), ("y", "y2999")]


def test_small_tables_only_are_broadcast(spark):
    other = spark.range(5)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(other.join(small(spark.range(10)), "id")) and "broadcast" not in plan(other.join(small(spark.range(10), most=9), "id"))


def test_last_rows_of_hot_keys(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("f")).unionByName(spark.createDataFrame([(None, 9, 9)], "k int, id long, f long"))
    assert sorted(map(tuple, ingest.last_of_each(rows, "k", [F.col("f"), F.col("id")]).collect()), key=str) == [(1, 4997, 6), (None, 9, 9)]
    assert sorted(map(tuple, ingest.first_file_wins(rows, "k", "f", "id").collect()), key=str) == [(1, 4998, 0), (None, 9, 9)]
