"""Cuts at separators, templates of pages, and lines of split files against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import templates
from tessella.operators import chunking
from tessella.sources import collections, jsonl


def test_text_is_cut_at_the_coarsest_separator_that_does():
    text = "one two three\n\nfour five. six seven\neight\n\n" + "nine " * 7
    assert chunking.split_text("one two three\n\nfour five", 4, 0) == ["one two three", "four five"]
    assert chunking.split_text(text, 5, 0) == ["one two three", "four five. six seven\neight", "nine nine nine nine nine", "nine nine"]
    assert chunking.split_text("a b c d e f", 4, 2) == ["a b c d", "c d e f"]
    assert chunking.split_text("", 5) == [] and chunking.split_text(" \n ", 5) == []
    assert chunking.split_text("x" * 30, 5, 0) == ["xxxxx"] * 6


def test_parts_fit_and_lose_nothing():
    rng = random.Random(5)
    for _ in range(60):
        words = [f"w{k}" for k in range(rng.randrange(1, 200))]
        text = "".join(w + rng.choice((" ", " ", "\n", "\n\n", ". ", "},", '",')) for w in words)
        budget, overlap = rng.randrange(4, 40), rng.choice((0, 2))
        parts = chunking.split_text(text, budget, overlap)
        assert all(0 < chunking.count_tokens(p) <= budget and p in text and p == p.strip() for p in parts)
        seen = [w for p in parts for w in chunking._TOKEN.findall(p)]
        assert list(dict.fromkeys(seen)) == words
        if not overlap:
            assert seen == words


def test_chunks_in_spark(spark):
    docs = spark.createDataFrame([(1, "word " * 300, "s"), (2, None, "s"), (3, "short", None)], "chunk_id int, content string, source string")
    got = chunking.recursive_chunks(docs, {"Source": F.col("source")}, budget=120, overlap=10).collect()
    assert [r.chunk_index for r in got if r.chunk_id == 1] == [0, 1, 2] and all(r.token_count <= 120 for r in got)
    assert {r.chunk_id: r.page_content for r in got if r.chunk_id > 1} == {2: "Source: s | Data: ", 3: " | Data: short"}


def test_pages_and_short_texts(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    page = "<sm2>x</sm2>{{Key press|Q}} [[A|b]] [[c]] {{Axe}} {{H|Moss|y}} {{A|Root|Moss}} {{cf|z}} {{tooltip|t|h}}{{Symbol|s}}{{ValueColor|1|v|w}}{{ValueColor|n}} <code>k</code><br/>n<ref>r</ref> '''bold''' ''it'' |par}} }} () [ ] a *** b {{unknown|x"
    assert one(templates.page_text(F.lit(page))) == "Q b c Axe Moss|y Root (z) tv k n bold it   a b {{unknown|x"
    assert one(templates.short_text(F.lit(" {{H|Moss|x}} {{A|Root|Moss}} {{Attribute ID|a}} [[l|t]] {{tooltip|u|h}}{{cf|z}}  {{Symbol|s}} '''b''i' "))) == "Moss Root a t us bi'"
    assert one(templates.page_text(F.lit(None).cast("string"))) is None
    rules = "{{U|x|text=unit}} {{Key press|double}} {{Key press|a|b}} {{cf|a}} {{ValueColor|3|9}} {{ValueColor|x}} {{Attribute ID|s}} {{Other|{{cf|a}}}}"
    assert one(templates.text_templates(F.lit(rules))) == "unit double-tapping a|b (a) 9  s {{Other|(a)}}"


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = {name: [f"{name} {k} " + "x" * (k % 50) if k % 7 else "" for k in range(3000)] for name in ("a.txt", "b.txt")}
    for name, some in lines.items():
        (tmp_path / "in" / name).write_text("\n".join(some) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9999")
    try:
        got = jsonl.read_lines(spark, f"{tmp_path}/in").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file, r.line_no): r.line for r in got} == {(n, k + 1): x for n, some in lines.items() for k, x in enumerate(some)}
    assert len(got) == 6000


def test_ids_of_lines_and_first_lines(spark):
    lines = ['{"id": 7, "passage": "p"}', '{"metadata": {"_id": "m"}, "text": "t"}', '{"metadata": {"game": "G", "full_path": "a.b"}, "text": "u"}', '{"chunk_id": null, "id": 1, "text": "x"}', "", '{"id": 7, "text": "last"}', "not json", '{"meta": {"hero": "h"}, "text": "v"}']
    rows = spark.createDataFrame([("f", k + 1, x) for k, x in enumerate(lines)], "file string, line_no long, line string")
    assert {r.chunk_id: r.content for r in jsonl.chunk_texts(rows).collect()} == {"7": "last", "m": "t", "G_general_a.b_0": "u"}
    broken = spark.createDataFrame([("f", 1, '{"text": "no id"}'), ("g", 1, " ")], "file string, line_no long, line string")
    with pytest.raises(ValueError, match="first line of f"):
        jsonl.chunk_texts(broken)
    assert jsonl.chunk_texts(broken, strict=False).count() == 0


def test_lines_are_parsed_for_what_their_keys_name(spark):
    lines = ['{"metadata": "{\\"id\\": 1, \\"game\\": \\"g\\"}", "text": "t"}', '{"metadata": {"_id": null}, "meta": {"id": 4}, "text": "t"}', '{"metadata": {"game": null, "hero": ""}, "meta": {"game": "h", "hero": "z"}, "content": null, "text": "t"}', '{"id": null, "id": 2, "text": "x", "text": "y"}']
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines, 2)], "file string, line_no long, line string")
    assert [(r.chunk_id, r.content) for r in jsonl.resolved(rows).orderBy("line_no").collect()] == [(None, "t"), (None, "t"), ("h_general_unknown_path_0", "t"), ("2", "x")]
    assert sorted((r.chunk_id, r.content) for r in jsonl.chunk_texts(rows).collect()) == [("2", "x"), ("h_general_unknown_path_0", "t")]
    plan = jsonl.chunk_texts(rows)._jdf.queryExecution().optimizedPlan().toString()
    # no line is written anew for its keys, and no filter parses what a projection parses again
    assert ", $)" not in plan and not [x for x in plan.splitlines() if "Filter" in x and ("get_json_object" in x or "json_object_keys" in x)]


def test_collections_keep_their_settings(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(ValueError, match="no collection"):
        collections.create_or_open(spark, f"{tmp_path}/c")
    assert collections.create_or_open(spark, f"{tmp_path}/c", vectors).count() == 2
    assert collections.create_or_open(spark, f"{tmp_path}/c", vectors.limit(0)).count() == 2
    assert tuple(collections.settings(spark, f"{tmp_path}/c").first()) == ("cosine", 2)
    with pytest.raises(ValueError, match="no metric"):
        collections.create_or_open(spark, f"{tmp_path}/d", vectors, "dot")
    assert collections.check_dimension(spark, f"{tmp_path}/c", vectors).count() == 2
    with pytest.raises(Exception, match="hasn't 2 dimensions"):
        collections.check_dimension(spark, f"{tmp_path}/c", spark.createDataFrame([([1.0],)], "embedding array<double>")).collect()
