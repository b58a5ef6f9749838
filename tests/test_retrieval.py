"""Order-sensitive rules of the retrieval pipeline on fixtures worked out by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.config import RerankConfig, RetrievalConfig, TierConfig
from tessella.functions import text as T
from tessella.operators import bm25, chunking, dense, evaluate, faithfulness, fusion, generation, ingest, orchestrate, rerank, retrievers
from tessella.operators.windows import window_starts
from tessella.sources import jsonl
from tessella.streaming.upserts import upsert_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("The Dog's café, x-1"))) == ["the", "dog", "caf", "x", "1"]
    assert one(spark, T.stripped(F.lit("  a \n"))) == "a"
    assert one(spark, T.infobox_value(F.lit("{{Box\n| name =  Foo bar \n| id=7\n}}"), "name")) == "Foo bar"
    assert one(spark, T.infobox_value(F.lit("x"), "name")) is None
    assert one(spark, T.plain(F.lit("'''A''' [[b|c]] {{d}}<br>&nbsp;e"))) == "A c e"
    assert one(spark, T.without_placeholders(F.lit("a [VAR:[G:x]]b"))) == "a b"
    assert [one(spark, T.base_value(F.lit(x))) for x in ("1/2/3", "12 (+3)", "none")] == ["1/2/3", "12", "none"]
    assert one(spark, T.pick(F.lit("a.b.c"), ".", F.lit(1))) == "b" and one(spark, T.pick(F.lit("a"), ".", F.lit(4))) == "a"
    assert one(spark, T.at_level(T.level_values(F.lit("5/10")), F.lit(4))) == 10.0
    assert one(spark, T.bullets(F.lit("x\n* a\n** b\n*"))) == ["a", "b"]
    assert one(spark, T.without_prefix(F.lit("Game: X | Hero: Y | Data: runs | fast"))) == "X, Y. runs. fast"
    assert one(spark, T.claims(F.lit("Too short. This has three. Is it so now? yes"))) == ["This has three.", "Is it so now?"]
    assert one(spark, T.pipe_list(F.lit(" a | | b"))) == ["a", "b"] and one(spark, T.pipe_list(F.lit(None).cast("string"))) == []


def test_bm25_by_hand(spark):
    docs = [(1, "d", "cat cat dog"), (2, "d", "cat bird"), (3, "d", "cat fish fish fish"), (4, "e", "dog")]
    index = bm25.build_index(spark.createDataFrame(docs, "chunk_id long, domain string, content string"))
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in {"cat": 3, "dog": 1, "bird": 1, "fish": 1}.items()}
    mean = sum(idf.values()) / 4
    found = {r.term: r.idf for r in index.terms.where("domain = 'd'").collect()}
    assert found["cat"] == pytest.approx(0.25 * mean) and found["dog"] == pytest.approx(idf["dog"])
    asked = spark.createDataFrame([(9, "fish fish"), (8, "")], "query_id long, question string")
    (hit,) = bm25.search(index, asked).collect()
    assert hit.chunk_id == 3 and hit["rank"] == 1 and hit.score == pytest.approx(2 * idf["fish"] * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 4 / 3)))


def test_fusion_ties_and_allocations(spark):
    rows = [(1, "a", 10, 0.9, 1, "dense"), (1, "a", 11, 3.0, 1, "sparse"), (1, "a", 10, 2.0, 2, "sparse"), (1, "b", 20, 0.8, 1, "dense"), (1, "b", 21, 0.7, 2, "dense")]
    lists = spark.createDataFrame(rows, "query_id long, domain string, chunk_id long, score double, rank int, source string")
    domains = spark.createDataFrame([("b", 0, 1), ("a", 1, 2)], "domain string, place int, allocation int")
    fused = fusion.fuse(lists, domains)
    assert [(r.chunk_id, r.position) for r in fusion.per_domain(fused, domains).orderBy("position").collect()] == [(20, 1), (10, 2), (11, 3)]
    assert [r.chunk_id for r in fusion.over_all(fused, 3).orderBy("position").collect()] == [10, 20, 11]
    both = fused.where("chunk_id = 10").first()
    assert both.rrf == pytest.approx(1 / 61 + 1 / 62) and (both.dense_rank, both.sparse_rank) == (1, 2)
    assert fusion.majority_domain(domains).first()[0] == "a"
    kept = fusion.counts(lists, fusion.per_domain(fused, domains)).first()
    assert (kept.dense_count, kept.sparse_count, kept.fused_count) == (3, 2, 3)


def test_gate_budget_and_placement(spark):
    rows = [(1, k, k, s, t) for k, (s, t) in enumerate([(0.9, 2000), (0.45, 1000), (0.4499, 10), (0.8, 1600), (0.5, 1)])] + [(2, 7, 0, 0.1, 9000), (2, 8, 1, 0.1, 1)]
    scored = spark.createDataFrame([(q, c, p, s, t, f"t{c}") for q, c, p, s, t in rows], "query_id long, chunk_id long, position int, score double, token_count int, content string")
    placed = rerank.place(rerank.gate(scored))
    got = {(r.query_id, r.chunk_id): (r["rank"], r.passed_gate, r.in_context, r.context_position) for r in placed.collect()}
    assert got[1, 0] == (1, True, True, 1) and got[1, 3] == (2, True, False, None) and got[1, 4] == (3, True, False, None)
    assert got[1, 2] == (5, False, False, None) and got[2, 7] == (1, True, True, 1) and got[2, 8][1] is False
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    stats = {r.query_id: r for r in rerank.admitted_statistics(queries, placed).collect()}
    assert (stats[1].n_context, stats[1].n_trimmed, stats[1].n_gated_out) == (1, 3, 1) and stats[2].fallback and stats[3].n_context == 0
    for n in range(1, 7):
        edges = rerank.place(rerank.gate(spark.createDataFrame([(1, k, k, 1.0 - k / 100, 1, "") for k in range(n)], scored.schema)), RerankConfig(), "edges")
        order = [r["rank"] for r in edges.orderBy("context_position").collect()]
        assert order == [k for k in range(2, n + 1, 2)] + [k for k in range(n, 0, -1) if k % 2]
    assert rerank.contexts(placed).where("query_id = 1").first().context == "t0"


def test_scores_of_long_queries_and_empty_texts(spark):
    asked = spark.createDataFrame([(1, "red cat"), (2, "w " * 151)], "query_id long, question string")
    rows = [(1, 1, 0, "a red dog", 3), (1, 2, 1, "x " * 600 + "red cat", 602), (1, 3, 2, "", 0), (2, 4, 0, "w", 1)]
    got = {r.chunk_id: r.score for r in rerank.score_candidates(asked, spark.createDataFrame(rows, "query_id long, chunk_id long, position int, content string, token_count int")).collect()}
    assert got == {1: 0.5, 2: round(1 / (1 + math.exp(-1)), 4), 3: round(1 / (1 + math.exp(1)), 4)}


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 400), st.integers(-3, 120))
def test_windows_cover_every_token(spark, length, budget):
    starts = one(spark, window_starts(F.lit(length), F.lit(budget)))
    if budget <= 0:
        assert starts == []
    elif length <= budget:
        assert starts == [0]
    else:
        assert {i for s in starts for i in range(s, s + budget)} == set(range(length)) and max(starts) == length - budget


def test_claims_and_tiers(spark):
    told = spark.createDataFrame([(1, "Cats like warm milk. Dogs bark at night."), (2, None)], "query_id long, answer string")
    chunks = spark.createDataFrame([(1, 0, "cats like milk"), (1, 1, "like cats milk"), (1, 2, None)], "query_id long, chunk_no long, content string")
    checked = faithfulness.check_claims(faithfulness.split_claims(told), chunks)
    first, second = checked.orderBy("claim_no").collect()
    assert (first.best_entailment, first.faithful, first.supporting_chunk) == (0.75, True, 0) and (second.faithful, second.supporting_chunk) == (False, None)
    stats = {r.query_id: r for r in faithfulness.summarise(told, checked).collect()}
    assert stats[1].n_faithful == 1 and stats[2].n_claims == 0
    tiers = [one(spark, orchestrate.tier(F.lit(x))) for x in (0.7001, 0.70, 0.50, 0.20, 0.1999)]
    assert tiers == ["high", "moderate", "low", "low", "dead"]
    with pytest.raises(ValueError):
        TierConfig(reranker_weight=0.5, faithfulness_weight=0.6)


def test_generation_side(spark):
    rows = [(1, []), (2, [-0.01, -0.02, -0.03]), (3, [-1.0, -0.01]), (4, [-60.0, -1.0])]
    got = {r.query_id: r for r in generation.factual_confidence(spark.createDataFrame(rows, "query_id long, logprobs array<double>")).collect()}
    assert (got[1].confidence, got[1].n_factual) == (0.0, 0) and got[2].confidence == pytest.approx(math.exp(-0.02)) and got[2].n_factual == 0
    assert got[3].confidence == pytest.approx(math.exp(-1)) and got[4].confidence == pytest.approx(math.exp(-1) / 2)
    answers = spark.createDataFrame([(1, "q", "c", "I cannot answer"), (2, "q", "c", "fine"), (3, "q", "c", "I CANNOT ANSWER")], "query_id long, question string, context string, answer string")
    out = spark.createDataFrame([(1, 5, "more", 0.3, 1, False), (2, 6, "more", 0.3, 1, False)], "query_id long, chunk_id long, content string, score double, rank int, passed_gate boolean")
    tried = generation.retry(answers, out, lambda df: df.select("query_id", F.concat(F.lit("from "), "context").alias("answer")), ["cannot answer"])
    assert {r.query_id: (r.answer, r.retried, r.injected_chunk) for r in tried.collect()} == {1: ("from more\n\nc", True, 5), 2: ("fine", False, None), 3: ("I CANNOT ANSWER", False, None)}
    entities = spark.createDataFrame([(1, "Otto"), (1, "anna"), (1, None)], "query_id long, entity string")
    assert generation.unmentioned_entities(spark.createDataFrame([(1, "Is Anna here?")], "query_id long, question string"), entities).first().entities == ["Otto"]


def test_metrics(spark):
    rankings = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "query_id long, chunk_id long, position int")
    truth = spark.createDataFrame([(1, 6), (1, 6), (2, 9)], "query_id long, chunk_id long")
    queries = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "query_id long, kind string")
    got = evaluate.rank_metrics(rankings, truth, queries)
    rows = {r.query_id: r for r in got.collect()}
    assert (rows[1].hit_1, rows[1].hit_3, rows[1].rr) == (0.0, 1.0, 0.5) and rows[2].rr == 0.0 and rows[3].rr is None
    summary = {r["slice"] if not r["level"] else "all": r for r in evaluate.summarise(got, "kind").collect()}
    assert summary["x"].rr == 0.25 and summary["y"].rr is None and summary["all"].n == 3
    assert evaluate.describe(got).where("metric = 'rr'").first().q50 == 0.25
    both = evaluate.join_sheets(spark.createDataFrame([("a", "low")], "Query string, tier string"), spark.createDataFrame([("a", "high")], "question string, tier string"))
    assert both.columns == ["question", "tier_run", "tier_truth"]


def test_dense_search_in_blocks(spark):
    vectors = spark.createDataFrame([(k, "a" if k % 2 else None, [float(k), 1.0]) for k in range(9)] + [(99, "a", None), (98, "a", [0.0, 0.0])], "chunk_id long, domain string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "query_id long, embedding array<double>")
    got = dense.search(vectors, asked, RetrievalConfig(per_source=2), block=1)
    assert sorted((r.query_id, str(r.domain), r["rank"], r.chunk_id) for r in got.collect()) == [(1, "None", 1, 8), (1, "None", 2, 6), (1, "a", 1, 7), (1, "a", 2, 5), (2, "None", 1, 0), (2, "None", 2, 2), (2, "a", 1, 1), (2, "a", 2, 3)]
    assert dense.search(vectors, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dense.dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))


def test_predicates_cut_before_the_k_best(spark):
    vectors = spark.createDataFrame([(f"c{k}", "a", [float(k), 1.0], {"game": "xy"[k % 2], "no": None}) for k in range(8)] + [("none", "a", [9.0, 1.0], None)], "chunk_id string, domain string, embedding array<double>, metadata map<string,string>")
    rows = [("all", None), ("empty", {}), ("x", {"game": "x"}), ("both", {"game": "y", "other": "z"}), ("null", {"no": None})]
    asked = spark.createDataFrame([(q, [1.0, 0.0], w) for q, w in rows], "query_id string, embedding array<double>, where map<string,string>")
    got = dense.search(vectors, asked, RetrievalConfig(per_source=2))
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [("all", 1, "none"), ("all", 2, "c7"), ("empty", 1, "none"), ("empty", 2, "c7"), ("x", 1, "c6"), ("x", 2, "c4")]
    assert {r.query_id for r in dense.search(vectors.drop("metadata"), asked).collect()} == {"all", "empty"}


def test_string_ids_and_ties(spark):
    docs = spark.createDataFrame([(f"k{k}", "d", "same words here") for k in (3, 10, 1)] + [("z", None, "same"), ("e", "d", None)], "chunk_id string, domain string, content string")
    asked = spark.createDataFrame([("q1", "words here"), ("q2", None)], "query_id string, question string")
    got = bm25.search(bm25.build_index(docs), asked, RetrievalConfig(per_source=2))
    assert got.count() == 0  # every term is in most chunks, and the vocabulary's mean idf is negative
    more = docs.unionByName(spark.createDataFrame([(f"f{k}", "d", f"other{k} text{k}") for k in range(9)], docs.schema))
    got = bm25.search(bm25.build_index(more), asked, RetrievalConfig(per_source=2))
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [("q1", 1, "k1"), ("q1", 2, "k10")]
    assert bm25.search(bm25.build_index(more.limit(0)), asked).count() == 0


def plain_bm25(docs, questions, k):
    """{(query, domain): [(chunk, score)]} by the formula, chunk by chunk."""
    import re
    from collections import Counter

    words = lambda t: re.findall("[a-z0-9]+", re.sub(r"'s\\b", "", (t or "").lower()))
    out = {}
    for domain in sorted({d for _, d, _ in docs}):
        own = [(c, Counter(words(t))) for c, d, t in docs if d == domain]
        avgdl, df = sum(sum(x.values()) for _, x in own) / len(own), Counter(t for _, x in own for t in x)
        idf = {t: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        idf = {t: v if v >= 0 else 0.25 * sum(idf.values()) / len(idf) for t, v in idf.items()}
        for q, text in questions:
            scores = []
            for c, x in own:
                long = 1.5 * (0.25 + 0.75 * sum(x.values()) / avgdl)
                scores.append((c, sum(n * idf[t] * x[t] * 2.5 / (x[t] + long) for t, n in Counter(words(text)).items() if t in x)))
            best = sorted((s for s in scores if s[1] > 0), key=lambda s: (-round(s[1], 9), s[0]))[:k]
            if best:
                out[q, domain] = best
    return out


def test_blocks_skip_nothing_that_counts(spark):
    """All results against the formula, and how many pairs the bounds leave to be scored."""
    import random

    rng = random.Random(8)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(3000)]
    docs = [(k, f"d{k % 3}", " ".join(rng.choices(common, k=rng.randrange(1, 90)) + rng.choices(rare, k=rng.randrange(9)))) for k in range(6000)]
    asked = [(k, " ".join(rng.choices(rare, k=6) + rng.choices(common, k=2))) for k in range(40)]
    index = bm25.build_index(spark.createDataFrame(docs, "chunk_id long, domain string, content string").repartition(4))
    queries = spark.createDataFrame(asked, "query_id long, question string")
    got = {}
    for r in bm25.search(index, queries, RetrievalConfig(per_source=3)).orderBy("rank").collect():
        got.setdefault((r.query_id, r.domain), []).append((r.chunk_id, pytest.approx(r.score)))
    assert got == plain_bm25(docs, asked, 3)
    scored, pairs = bm25.scored_pairs(index, queries, RetrievalConfig(per_source=3))
    assert pairs == 6000 * 40 and scored < 0.7 * pairs


def test_cells_skip_what_is_far(spark):
    import random

    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    near = lambda k: [x + rng.gauss(0, 0.05) for x in centres[k % 40]]
    vectors = spark.createDataFrame([(f"v{k}", "d", near(k)) for k in range(4000)], "chunk_id string, domain string, embedding array<double>").coalesce(1)
    asked = [(k, near(k)) for k in range(20)]
    cells, queries = dense.cell_index(vectors).persist(), spark.createDataFrame(asked, "query_id int, embedding array<double>")
    scored, pairs = dense.scored_pairs(cells, queries)
    assert pairs == 4000 * 20 and scored < 0.1 * pairs
    got = dense.search(cells, queries, RetrievalConfig(per_source=5)).collect()
    assert len(got) == 100 and all(int(r.chunk_id[1:]) % 40 == r.query_id % 40 for r in got)


def test_ingestion_and_chunking(spark):
    assert one(spark, ingest.chunk_id(F.lit(None).cast("string"), [F.lit(""), F.lit("Lux")], F.lit("a/b"), F.lit(None).cast("int"))) == "Unknown_Lux_a/b_0"
    assert one(spark, ingest.sanitised(F.expr("map('A', 'x', 'a', 'y', 'b', null)"))) == {"a": "y"}
    old = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "k long, v string, n long")
    new = spark.createDataFrame([(2, "z", 1), (2, "w", 2), (3, "q", 1)], old.schema)
    merged = ingest.upsert(old, new, "k", ["n"])
    assert sorted(map(tuple, merged.collect())) == [(1, "x", 0), (2, "w", 2), (3, "q", 1)]
    assert sorted(map(tuple, ingest.upsert(merged, new, "k", ["n"]).collect())) == sorted(map(tuple, merged.collect()))
    assert one(spark, chunking.bundles(F.array(*map(F.lit, [3, 4, 9, 1, 1])), 7)) == [0, 0, 1, 2, 2]
    docs = spark.createDataFrame([(1, "w " * 700), (2, ""), (3, None)], "chunk_id long, content string")
    got = chunking.word_chunks(docs, {"Game": F.lit("X"), "None": F.lit(None).cast("string")}).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == [0, 1] and got[0].page_content.startswith("Game: X | Data: w") and all(r.token_count <= 512 for r in got)


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('\n{"id": 1, "text": "a"}\n{broken\n{"chunk_id": 2}\n')
    scanned = jsonl.scan_tolerant(jsonl.read_lines(spark, f"{tmp_path}/in"))
    assert [(r.line_no, r.error) for r in scanned.orderBy("line_no").collect()] == [(2, None), (3, "{broken"), (4, None)]
    assert [r.x for r in scanned.where("error IS NULL").orderBy("line_no").select(jsonl.first_field(F.col("line"), ["id", "chunk_id"]).alias("x")).collect()] == ["1", "2"]
    chunks = spark.createDataFrame([("t", {"game": "X"}, 1)], jsonl.CHUNK_SCHEMA)
    jsonl.write_chunks(chunks, f"{tmp_path}/out")
    assert jsonl.read_chunks(spark, f"{tmp_path}/out").collect() == chunks.collect()
    for n, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(2, "c", 2)])):
        spark.createDataFrame(rows, "k long, v string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/stream")
        stream = spark.readStream.schema("k long, v string, n long").parquet(f"{tmp_path}/stream")
        upsert_stream(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint", "k", ["n"]).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table/version=1").collect())) == [(1, "a", 1), (2, "c", 2)]


def test_retrievers_over_questions_embedded_once(spark):
    docs = spark.createDataFrame([(f"c{k}", "d", f"word{k} text") for k in range(9)], "chunk_id string, domain string, content string")
    cells = dense.cell_index(docs.select("chunk_id", "domain", F.array(F.length("content").cast("double"), F.xxhash64("content") % 7 + 0.5).alias("embedding")))
    both = [retrievers.Sparse(bm25.build_index(docs)), retrievers.Dense(cells, RetrievalConfig(per_source=2))]
    assert all(isinstance(r, retrievers.Retriever) for r in both)
    asked = spark.createDataFrame([("q", "word3")], "query_id string, question string")
    got = retrievers.ranked(asked, both, lambda text: F.array(F.length(text).cast("double"), F.lit(0.5)))
    lists = {(r.source, r["rank"]): r.chunk_id for r in got.collect()}
    assert lists["sparse", 1] == "c3" and {k for k in lists if k[0] == "dense"} == {("dense", 1), ("dense", 2)}


def test_pieces_of_large_batches(spark, tmp_path):
    import pyarrow as pa

    from tessella.operators import blocks

    batches = [pa.RecordBatch.from_arrays([pa.array([[f"{k}-{i}" for i in range(10)] for k in range(n)])], ["t"]) for n in (3, 5000, 0, 7)]
    pieces = list(blocks.buffered(batches, 1000, 1 << 14))
    assert max(p.nbytes for p in pieces) < 1 << 16 and all(p.column(0).chunk(0).offsets[0].as_py() == 0 for p in pieces)
    assert [x for p in pieces for x in p.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]

    import pyarrow.parquet as pq

    docs = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("chunk_id"), F.lit("d").alias("domain"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.xxhash64("id", i).cast("string")), " ").alias("content"))
    found = bm25.build_index(docs).blocks.inputFiles()
    read = [pq.ParquetFile(x.removeprefix("file:")).metadata for x in found]
    groups = [m.row_group(g).total_byte_size for m in read for g in range(m.num_row_groups)]
    assert len(groups) > 2 and max(groups) < 1 << 23


def test_lists_go_to_the_texts(spark, tmp_path):
    from tessella.plans import queries as plans

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), (F.col("doc_id") * i % 50).cast("string"))), " ")
    docs = spark.range(60).select(F.col("id").alias("doc_id")).select("doc_id", words.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    passage = F.concat_ws(" ", F.slice(F.split("text", " "), 3, 6))
    docs.where("doc_id < 3").select(F.col("doc_id").alias("item_id"), passage.alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        placed, found = plans.placed_candidates(spark, str(tmp_path)), plans.truths(spark, str(tmp_path))
        for told in (placed, found):
            plan = told._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin [chunk_id" in plan and "SortMergeJoin [chunk_id" not in plan
        assert placed.select("query_id").distinct().count() == 3
        assert {(r.query_id, r.chunk_id) for r in found.collect()} >= {(k, k) for k in range(1, 3)}
    finally:
        spark.conf.set(key, before)


def test_python_gets_small_batches(spark):
    import pyarrow as pa

    from tessella import storage

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t")).mapInArrow(sizes, "n long")
    got = [r.n for r in storage.stored_in_pieces(wide, "wide").collect()]
    assert sum(got) >= 40_000_000 and max(got) < 2 * storage.PIECE and spark.conf.get(key) == before


def test_postings_of_a_few_tokens_at_once():
    import tracemalloc
    from collections import Counter
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from tessella import storage
    from tessella.operators import blocks

    got = {}
    ids = SimpleNamespace(schema={"chunk_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    ids.select = lambda *_: SimpleNamespace(mapInArrow=lambda f, schema: got.update(cut=f))
    bm25.posting_blocks(ids)
    random = np.random.default_rng(1)
    words = [[f"w{x}" for x in random.zipf(1.3, n) % 5000] for n in random.integers(0, 900, 1000)]
    table = pa.table({"chunk_id": range(1000), "domain": ["ab"[k % 2] for k in range(1000)], "t": words}).combine_chunks()
    tracemalloc.start()
    found = list(got["cut"](table.to_batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.nbytes < blocks.BUFFER_BYTES and peak < 4 * blocks.BUFFER_BYTES and 2 * storage.PIECE <= blocks.BUFFER_BYTES
    assert len(found) > 4 and max(b.nbytes for b in found) < blocks.BUFFER_BYTES
    rows = [r for b in found for r in b.to_pylist()]
    assert sum(-(-500 // blocks.ROWS) for _ in "ab") == len(rows) and max(len(r["chunk_ids"]) for r in rows) == blocks.ROWS
    counted = {}
    for r in rows:
        for i, term in enumerate(r["terms"]):
            for at in range(r["ends"][i - 1] if i else 0, r["ends"][i]):
                counted.setdefault(r["chunk_ids"][r["docs"][at]], Counter())[term] += r["counts"][at]
        for k, n in zip(r["chunk_ids"], r["lengths"], strict=True):
            assert r["domain"] == "ab"[k % 2] and n == len(words[k])
    assert counted == {k: Counter(w) for k, w in enumerate(words) if w}


def test_domains_need_no_python_workers(spark):
    from tessella.plans import queries as plans

    told = plans.domains(spark)
    assert "ExistingRDD" not in told._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in told.collect()] == plans.DOMAINS and [t for _, t in told.dtypes] == ["string", "int", "int"]


def test_tokens_of_listed_texts_only(spark, tmp_path):
    from tessella.plans import queries as plans

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id = 3").select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    placed = plans.placed_candidates(spark, str(tmp_path))
    lines = placed._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(lines) if "Join Inner" in x and "chunk_id" in x)
    assert not any("AS token_count" in x for x in lines[join:]) and any("AS token_count" in x for x in lines[:join])
    assert {r.token_count for r in placed.collect()} == {3}
