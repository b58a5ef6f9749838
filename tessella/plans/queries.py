"""The registered queries of the retrieval pipeline over the test tables.

Documents stand in for chunks with their language as domain, benchmark passages for questions,
documents that hold a passage for its ground truth, assistant turns for answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import templates
from ..functions import text as T
from ..operators import audit, bm25, chunking, dense, evaluate, faithfulness, fusion, generation, ingest, nodes, orchestrate, rerank, wiki
from ..operators.blocks import NARROW
from ..sources import buckets, jsonl
from ..storage import shared_folder, small, spread, stored, stored_in_pieces

#: The domains in their order, with allocations of the fused list.
DOMAINS = [("en", 0, 4), ("fr", 1, 3), ("de", 2, 2), ("es", 3, 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("domain"), F.coalesce("text", F.lit("")).alias("content"), "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def domains(spark: SparkSession) -> DataFrame:
    # rows of Python objects would go through a Python worker of every core, time and again
    rows = F.array(*[F.struct(F.lit(domain).alias("domain"), F.lit(place).alias("place"), F.lit(allocation).alias("allocation")) for domain, place, allocation in DOMAINS])
    return spark.range(1).select(F.inline(rows))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.col("text").alias("answer"))


#: Stored indexes of a session by the tables they are of.
_indexes: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """An index that all queries of a session over one folder share."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = build()
    return _indexes[key]


def sparse_index(spark: SparkSession, sf_dir: str) -> bm25.Bm25Index:
    return _once(spark, sf_dir, "bm25", lambda: bm25.build_index(chunks(spark, sf_dir)))


def sparse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(sparse_index(spark, sf_dir), questions(spark, sf_dir))


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    of = chunks(spark, sf_dir).select("chunk_id", "domain", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    told = vectors.join(of, F.col("vec_id") == F.col("chunk_id")).select("chunk_id", "domain", "embedding", "metadata")
    return _once(spark, sf_dir, "cells", lambda: stored_in_pieces(dense.cell_index(told), "cells", **NARROW))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def dense_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.search(dense_cells(spark, sf_dir), asked_vectors(spark, sf_dir))


def fused_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lists = stored(fusion.ranked_lists(dense_list(spark, sf_dir), sparse_list(spark, sf_dir)), "ranked-lists")
    return lists, fusion.fuse(lists, domains(spark))


def placed_candidates(spark: SparkSession, sf_dir: str, placement: str = "recency") -> DataFrame:
    """The sparse lists' chunks, scored, gated and placed."""
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    # the lists go to the texts: those of all chunks aren't shuffled and sorted for a few, nor are their tokens told
    listed = stored(sparse_list(spark, sf_dir).select("query_id", "chunk_id", position.alias("position")), "sparse-lists")
    found = small(listed).join(chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id").withColumn("token_count", T.token_count(F.col("content")))
    scored = rerank.score_candidates(questions(spark, sf_dir), found)
    return rerank.place(rerank.gate(scored), placement=placement)


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have all of a passage's tokens in its order, found by the passage's text."""
    docs = chunks(spark, sf_dir)
    # candidates share a passage's second to fifth word (its first may stick to what is before it); then whole passages are compared
    def hashes(text: str):
        return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))

    def at(i):
        return F.xxhash64(*[F.get("words", i + k) for k in range(4)])

    listed = docs.withColumn("words", hashes("content")).withColumn("starts", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 4)), at))
    starts = listed.select("chunk_id", F.explode(F.array_distinct("starts")).alias("h"))
    asked = questions(spark, sf_dir).withColumn("words", hashes("question")).select("query_id", "question", at(F.lit(1)).alias("h"))
    pairs = stored(starts.join(asked, "h").select("query_id", "chunk_id", "question").distinct(), "truth-candidates")
    found = small(pairs).join(docs.select("chunk_id", "content"), "chunk_id")
    return found.where(F.contains("content", F.col("question"))).select("query_id", "chunk_id").distinct()


def h1_tokens(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", T.token_count(F.col("content")).cast("long").alias("n_tokens"), F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


def h2_index_terms(spark, sf_dir):
    return sparse_index(spark, sf_dir).terms.select("domain", "term", "df", F.round("idf", 6).alias("idf"))


def h4_bm25_topk(spark, sf_dir):
    return sparse_list(spark, sf_dir).select("query_id", "domain", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def h5_dense_topk(spark, sf_dir):
    return dense_list(spark, sf_dir).select("query_id", "domain", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def h6_filtered_topk(spark, sf_dir):
    """Each third item asks for one source only, the next with no predicate, the last with an empty one."""
    item = F.col("query_id")
    where = F.when(item % 3 == 0, F.create_map(F.lit("source"), F.concat(F.lit("src"), (item % 20).cast("string")))).when(item % 3 == 1, F.create_map().cast("map<string,string>"))
    found = dense.search(dense_cells(spark, sf_dir), asked_vectors(spark, sf_dir).withColumn("where", where))
    return found.select("query_id", "domain", "chunk_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def h8_merged_lists(spark, sf_dir):
    fused = fused_lists(spark, sf_dir)[1]
    return fused.select("query_id", "domain", "chunk_id", F.round("rrf", 6).alias("rrf"), F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"))


def h9_rrf_per_domain(spark, sf_dir):
    kept = fusion.per_domain(fused_lists(spark, sf_dir)[1], domains(spark))
    return kept.select("query_id", "domain", "chunk_id", F.round("rrf", 6).alias("rrf"), F.col("position").cast("long").alias("position"))


def h10_rrf_over_all(spark, sf_dir):
    kept = fusion.over_all(fused_lists(spark, sf_dir)[1])
    return kept.select("query_id", "domain", "chunk_id", F.round("rrf", 6).alias("rrf"), F.col("position").cast("long").alias("position"))


def h12_counts(spark, sf_dir):
    lists, fused = fused_lists(spark, sf_dir)
    return fusion.counts(lists, fusion.per_domain(fused, domains(spark))).crossJoin(F.broadcast(fusion.majority_domain(domains(spark))))


def i9_gate(spark, sf_dir):
    placed = placed_candidates(spark, sf_dir)
    return placed.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), "passed_gate", "fallback")


def i11_context(spark, sf_dir):
    placed = placed_candidates(spark, sf_dir).where("in_context")
    return placed.select("query_id", "chunk_id", F.col("context_position").cast("long").alias("context_position"))


def i12_context_edges(spark, sf_dir):
    placed = placed_candidates(spark, sf_dir, "edges").where("in_context")
    return placed.select("query_id", "chunk_id", F.col("context_position").cast("long").alias("context_position"))


def i13_admitted(spark, sf_dir):
    found = rerank.admitted_statistics(questions(spark, sf_dir), placed_candidates(spark, sf_dir))
    return found.select("query_id", "n_context", "n_trimmed", "n_gated_out", "context_tokens", "max_score", "min_score", "fallback")


def i15_context_text(spark, sf_dir):
    found = rerank.contexts(placed_candidates(spark, sf_dir))
    return found.select("query_id", F.md5("context").alias("context_md5"), F.size("citations").cast("long").alias("n_citations"))


def j1_prompt(spark, sf_dir):
    asked = questions(spark, sf_dir)
    return asked.select("query_id", F.md5(generation.prompt(F.col("question"), F.lit("none"))).alias("prompt_md5"))


def j8_abstentions(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", generation.abstains(F.col("answer"), generation.ABSTENTIONS).alias("abstains"))


def claim_check(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Claims of assistant turns against the other turns of their conversation, in order."""
    told = answers(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").where("role <> 'assistant'")
    context = told.select("query_id", "conv_id").join(turns, "conv_id").select("query_id", F.col("turn").alias("chunk_no"), F.col("text").alias("content"))
    return told, faithfulness.check_claims(faithfulness.split_claims(told), context)


def k5_claims(spark, sf_dir):
    checked = claim_check(spark, sf_dir)[1]
    return checked.select("query_id", F.col("claim_no").cast("long").alias("claim_no"), "claim", F.round("best_entailment", 4).alias("best_entailment"), "faithful", "supporting_chunk")


def k7_faithfulness(spark, sf_dir):
    return faithfulness.summarise(*claim_check(spark, sf_dir)).withColumn("mean_entailment", F.round("mean_entailment", 8))


def l6_tiers(spark, sf_dir):
    """Benchmark items answered by their own text."""
    asked = questions(spark, sf_dir)
    placed = stored(placed_candidates(spark, sf_dir), "placed")
    told = asked.select("query_id", F.col("question").alias("answer"))
    context = placed.where("in_context").select("query_id", F.col("rank").alias("chunk_no"), "content")
    checked = faithfulness.check_claims(faithfulness.split_claims(told), context)
    out = orchestrate.orchestrate(told, placed, checked)
    return out.select("query_id", "reranker_median", "max_entailment", "confidence", "tier", F.length("response").alias("response_chars"))


def m10_rank_metrics(spark, sf_dir):
    kept = fusion.over_all(fused_lists(spark, sf_dir)[1])
    found = evaluate.rank_metrics(kept, truths(spark, sf_dir), questions(spark, sf_dir).select("query_id"))
    return found.select("query_id", "n_truth", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


def m13_summary(spark, sf_dir):
    """By whether an item's text is longer than its mean of 40 tokens."""
    asked = questions(spark, sf_dir).select("query_id", F.when(T.token_count(F.col("question")) > 40, "long").otherwise("short").alias("kind"))
    kept = fusion.over_all(fused_lists(spark, sf_dir)[1])
    found = evaluate.summarise(evaluate.rank_metrics(kept, truths(spark, sf_dir), asked), "kind")
    return found.select("slice", "level", "n", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


def f1_findings(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("html").alias("text"))
    return audit.findings(pages).select("item_id", "type", F.col("match_count").cast("long").alias("match_count"), F.array_join("matches", "\n").alias("matches"))


def f4_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("html").alias("text"))
    return audit.counts(audit.findings(pages))


def d3_plain_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(templates.page_text(F.col("html"))).alias("plain_md5"))


def e2_word_chunks(spark, sf_dir):
    docs = chunks(spark, sf_dir)
    found = chunking.word_chunks(docs, {"Source": F.col("source"), "Language": F.col("domain")})
    return found.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("page_content").alias("content_md5"), F.col("token_count").cast("long").alias("token_count"))


def e3_recursive_chunks(spark, sf_dir):
    docs = chunks(spark, sf_dir)
    found = chunking.recursive_chunks(docs, {"Source": F.col("source"), "Language": F.col("domain")}, budget=130)
    return found.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("page_content").alias("content_md5"), F.col("token_count").cast("long").alias("token_count"))


def e5_bundles(spark, sf_dir):
    """Turns of a conversation packed into bundles of 60 tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_count(F.col("text")).alias("n"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("t"))
    packed = listed.select("conv_id", "t", chunking.bundles(F.transform("t", lambda x: x["n"]), 60).alias("b"))
    return packed.select("conv_id", F.explode(F.arrays_zip("t", "b")).alias("x")).select("conv_id", "x.t.turn", F.col("x.b").cast("long").alias("bundle"))


def g2_normalised(spark, sf_dir):
    v = dense.normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"), F.round(v[0], 6).alias("first"))


def g5_chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ingest.chunk_id(F.col("lang"), [F.lit(""), F.col("source")], F.lit(None).cast("string"), F.col("doc_id")).alias("chunk_id"))


def b4_upsert(spark, sf_dir):
    """The last event of each user, upserted over the first half of the day's events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    old = ingest.last_of_each(events.where("event_type <> 'purchase'"), "user_id", [F.col("ts"), F.col("event_id")])
    new = events.where("event_type = 'purchase'")
    return ingest.upsert(old, new, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def b4_buckets(spark, sf_dir):
    """Views, then other events, then purchases as batches of a bucketed table, each tried twice: a user's last event of the last batch."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kept = buckets.BucketedTable(spark, f"{shared_folder(spark)}/latest-events-{uuid.uuid4().hex}", "user_id", ["ts", "event_id"], buckets=16)
    for number, which in enumerate(("event_type = 'view'", "event_type NOT IN ('view', 'purchase')", "event_type = 'purchase'")):
        for _ in range(2):
            kept.apply(events.where(which), number)
    return kept.read().select("user_id", "event_id", "event_type")


def _told(spark, sf_dir, turn):
    """Conversations as pages (title, text): each turn as ``turn`` writes it, in their order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    listed = turns.groupBy(F.col("conv_id").alias("title")).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("title", F.array_join(F.transform("t", turn), "\n").alias("text"))


def d1_sections(spark, sf_dir):
    """Each role's turns as sections of one name: the last counts."""
    pages = _told(spark, sf_dir, lambda t: F.concat(F.lit("== "), t["role"], F.lit(" ==\n"), t["text"]))
    return wiki.sections(pages).select(F.col("title").alias("conv_id"), "section", F.md5("content").alias("content_md5"))


def d18_versions(spark, sf_dir):
    """Each turn as an element of a version table."""
    pages = _told(spark, sf_dir, lambda t: F.concat(F.lit("{{VersionTableElement|"), t["turn"], F.lit("|\n* "), t["role"], F.lit("\n** turn "), t["turn"]))
    return wiki.versions(pages).select(F.col("title").alias("conv_id"), F.col("position").cast("long").alias("position"), "version", "most_recent", F.array_join("changes", ";").alias("changes"))


def d4_derived(spark, sf_dir):
    """Parts as heroes: attributes and stats by their key and size."""
    key = F.col("p_partkey").cast("int")
    primary = F.element_at(F.array(*[F.lit(x) for x in ("Strength", "Agility", "Intelligence", "Universal")]), key % 4 + 1)
    heroes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("strength"), (key % 30).alias("agility"), (key % 25).alias("intelligence"), primary.alias("primary_attribute"))
    stats = {"attack_damage_min": key % 50, "attack_damage_max": key % 50 + 6, "health_regen": F.lit(0.5), "mana_regen": F.lit(None).cast("double"), "armor": F.lit(-1.0)}
    derived = wiki.with_derived(heroes.withColumns(stats))
    names = ("total_health", "total_mana", "damage_min", "damage_max", "total_health_regen", "total_mana_regen", "total_armor")
    return derived.select("p_partkey", *[F.col(n).cast("double").alias(n) for n in names])


def e4_nested_nodes(spark, sf_dir):
    """A record per conversation with its turns as a list of objects under a guide."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat_ws("-", "role", "turn").alias("name")).alias("t"))
    listed = turns.groupBy(F.col("conv_id").alias("record_id")).agg(F.array_sort(F.collect_list("t")).alias("t"))
    records = listed.select("record_id", F.to_json(F.struct(F.struct(F.struct(F.col("t").alias("told")).alias("turns")).alias("guide"))).alias("json"))
    found = nodes.dispatch(nodes.top_nodes(records))
    return found.select(F.col("record_id").alias("conv_id"), "primary_node", "sub_node", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def m6_contexts(spark, sf_dir):
    """Three listed ids per benchmark item, of which the last is unknown."""
    item = F.col("item_id")
    ids = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.array(item * 3 % 200, item, -1 - item).alias("chunk_ids"))
    found = evaluate.contexts(ids, chunks(spark, sf_dir))
    return found.select("query_id", F.md5(F.array_join("contexts", "|")).alias("contexts_md5"), "n_missing")


def b3_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("html").alias("text"))
    return audit.report(audit.findings(pages)).select("n_findings", F.array_join(F.col("by_type.type"), ",").alias("types"))


def h11_retrieval(spark, sf_dir):
    """Every seventh item isn't retrieved, every third allocates by itself; one language has no label."""
    asked = questions(spark, sf_dir)
    item = F.col("query_id")
    own = F.create_map(F.lit("en"), F.lit(2), F.lit("es"), F.lit(5))
    configs = asked.select("query_id", (item % 7 != 0).alias("should_retrieve"), F.when(item % 3 == 0, own).alias("allocation"))
    labels = domains(spark).withColumn("label", F.when(F.col("domain") == "fr", "none").otherwise(F.upper("domain")))
    counted = chunks(spark, sf_dir).select("chunk_id", F.col("domain").alias("label"), F.length("content").alias("token_count"), F.nullif((F.col("chunk_id") % 2).cast("int"), F.lit(2)).alias("metadata_count"))
    found = fusion.retrieved(fused_lists(spark, sf_dir)[1], configs, labels, counted)
    return found.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", "domain", "rrf", F.col("token_count").cast("long").alias("token_count"))


def i17_score_report(spark, sf_dir):
    placed = placed_candidates(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", "domain"), "chunk_id")
    found = rerank.score_report(placed)
    shown = F.array_join(F.transform(F.map_entries("domains"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.select("query_id", "n_scored", "n_gated_out", *[F.round(c, 6).alias(c) for c in ("max_score", "min_score", "median_score", "max_raw", "min_raw", "median_raw")], F.array_join("gated_out", ",").alias("gated_out"), shown.alias("domains"))


def i16_citations(spark, sf_dir):
    placed = placed_candidates(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", "domain", F.create_map(F.lit("source"), F.col("source")).alias("metadata")), "chunk_id")
    each = rerank.contexts(placed).select("query_id", F.explode("citations").alias("c")).select("query_id", "c.*")
    return each.select("query_id", F.col("context_position").cast("long").alias("context_position"), "chunk_id", "domain", "score", F.round("raw", 6).alias("raw"), F.col("metadata")["source"].alias("source"))


def run_sheet(spark, sf_dir):
    """Benchmark items as rows of a run sheet joined with its truth sheet, some of them blank."""
    item, text = F.col("item_id"), lambda x: x.cast("string")
    admitted = F.when(item % 5 == 0, " | ").otherwise(F.concat_ws(" | ", text(item), text(item + 1), F.lit(""), text(item + 2)))
    columns = {"Answer": F.when(item % 4 == 0, "  ").otherwise(F.col("text")), "Admitted Chunk IDs (Ranked)": admitted, "Gated-Out Chunk IDs (Ranked)": F.when(item % 3 == 0, F.concat_ws("|", text(item + 7), text(item * 2)))}
    truth = {"source_chunk_id_1": F.when(item % 6 == 0, " ").otherwise(text(item * 2)), "source_chunk_id_2": text(item * 2), "source_chunk_id_3": F.when(item % 2 == 0, text(item + 2)), "source_chunk_id_4": F.lit(""), "source_chunk_id_5": F.lit(None).cast("string"), "source_chunk_id_6": F.when(item % 9 == 0, F.concat(F.lit(" "), text(item), F.lit(" ")))}
    tier = F.concat(F.lit("T"), text(item % 3 + 1))
    return table(spark, sf_dir, "benchmark").select(item.alias("query_id"), tier.alias("tier"), F.lit("high").alias("Tier_"), *[c.alias(n) for n, c in (columns | truth).items()]).withColumnRenamed("Tier_", "Predicted")


def m9_list_metrics(spark, sf_dir):
    """The tier T1's runs: truth sets, whole rankings, which can be evaluated, and metrics."""
    runs = evaluate.of_tier(evaluate.renamed(run_sheet(spark, sf_dir)), "T1")
    admitted = F.col("admitted_chunk_ids_ranked")
    listed = runs.select("query_id", evaluate.truth_set().alias("truth"), evaluate.full_ranking(admitted, F.col("gated_out_chunk_ids_ranked")).alias("ranking"), evaluate.evaluable(F.col("answer"), admitted).alias("evaluable"))
    measured = listed.withColumns({n: F.round(c, 6) for n, c in evaluate.list_metrics(F.col("ranking"), F.col("truth")).items()})
    return measured.withColumns({"truth": F.array_join(F.array_sort("truth"), ","), "ranking": F.array_join("ranking", ",")})


def m14_describe(spark, sf_dir):
    """Sizes of parts as a metric of their own."""
    found = evaluate.describe(table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").cast("double").alias("price")), ["size", "price"])
    return found.select("metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "largest")])


def j5_confidence(spark, sf_dir):
    """Embeddings' negative absolute values as log-probabilities of tokens."""
    told = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logprobs"))
    return generation.factual_confidence(told).select("query_id", F.round("confidence", 6).alias("confidence"), "n_factual")


def j6_overrides(spark, sf_dir):
    """Conversations' answers by the share of their letters, against how faithful they are."""
    told = k7_faithfulness(spark, sf_dir)
    sure = (F.col("query_id") % 100) / 100
    return told.select("query_id", generation.overrides_context(sure, F.col("mean_entailment")).alias("overrides"))


def j7_entities(spark, sf_dir):
    """Sources as entities of an item's sparse candidates."""
    found = sparse_list(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", F.col("source").alias("entity")), "chunk_id").select("query_id", "entity")
    return generation.unmentioned_entities(questions(spark, sf_dir), found).select("query_id", F.array_join("entities", ",").alias("entities"))


def a8_first_file(spark, sf_dir):
    """Events as lines of one file per type: a user's last line of the first file."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return ingest.first_file_wins(events, "user_id", "event_type", "event_id")


def d16_guide(spark, sf_dir):
    """Turns as bullets of a guide's sections."""
    pages = _told(spark, sf_dir, lambda t: F.concat(F.lit("== "), t["role"], t["turn"].cast("string"), F.lit(" ==\n* turn "), t["turn"].cast("string"), F.lit("\n* "), F.length(t["text"]).cast("string")))
    found = wiki.guide(wiki.sections(pages))
    return found.select(F.col("title").alias("conv_id"), "section", F.col("item_no").cast("long").alias("item_no"), "item")


def d16_builds(spark, sf_dir):
    """Conversations as guides: turns as levels of two build orders, as tips, and as items of phases."""
    def page(t):
        side = F.when(t["turn"] % 2 == 0, "even").otherwise("odd")
        level = F.concat(F.lit("{{build order | title = "), t["role"], F.lit("\n| lvl"), t["turn"], F.lit(" = a"), t["turn"], F.lit("\n| lvl9 = z\n| lvl"), t["turn"], F.lit(" = "), side, F.lit("\n}}\n"))
        return F.concat(level, F.lit("<!-- -->"))

    pages = _told(spark, sf_dir, page)
    builds = wiki.guide_builds(pages).select(F.col("title").alias("conv_id"), F.col("build_no").cast("long").alias("build_no"), "name", F.explode("progression").alias("level", "ability"))
    return builds


def d16_items(spark, sf_dir):
    """Roles as phases of recommended items, one bullet a turn; of a role that comes again the last turn counts."""
    pages = _told(spark, sf_dir, lambda t: F.concat(F.lit("'''"), F.initcap(t["role"]), F.lit(" Items:'''\n* {{I|item "), t["turn"], F.lit("}} for ''turn'' "), t["turn"], F.lit("\n* no item")))
    framed = pages.withColumn("text", F.concat(F.lit("x <section begin=Items />"), "text", F.lit("\n<section end=Items />")))
    found = wiki.guide_items(framed)
    return found.select(F.col("title").alias("conv_id"), "phase", F.col("item_no").cast("long").alias("item_no"), "item", "description")


def d7_blocks(spark, sf_dir):
    """Turns as ability blocks, nested as deep as their number says; every fifth is followed by one that never ends."""
    deep = (F.col("turn") * 3).cast("int")
    bare = F.translate(F.coalesce("text", F.lit("")), "{}|\n", "")
    block = F.concat(F.lit("{{Ability\n| name = t"), "turn", F.lit("\n| v = "), F.repeat(F.lit("{{n|"), deep), bare, F.repeat(F.lit("}}"), deep), F.lit("\n}}"))
    tail = F.when(F.col("turn") % 5 == 0, " {{Ability\n| name = open {{").otherwise("")
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("title"), F.lit("Abilities").alias("section"), F.concat(F.lit("a }} "), block, F.lit(" b"), tail).alias("content"))
    found = wiki.abilities(pages)
    return found.select(F.col("title").alias("page"), "kind", "ability", F.md5("block").alias("block_md5"))


def c10_references(spark, sf_dir):
    """A chain of definitions through each conversation's turns, the first defined anew at its end."""
    def turn(t):
        return F.concat(F.lit("{{#vardefine:v"), t["turn"], F.lit("|{{#var:v"), t["turn"] - 1, F.lit("}}."), t["role"], F.lit("}}"))

    pages = _told(spark, sf_dir, turn)
    text = F.concat(F.lit("{{#vardefineecho:v-1|start}}"), "text", F.lit("{{#vardefine:v-1|end}} {{#var:v1}} {{#var:v-1}} {{#var:none}}"))
    shown = templates.resolved(text, F.create_map().cast("map<string,string>"))
    return pages.select(F.col("title").alias("conv_id"), F.replace(F.replace(shown, F.lit("\n"), F.lit("")), F.lit("VAR:v1"), F.lit("none yet")).alias("text"))


def c2_variables(spark, sf_dir):
    """Turns as abilities, named by their role, with a cooldown, mana of one turn, and values that refer to each other."""
    def turn(t):
        number = t["turn"].cast("string")
        lines = [F.concat(F.lit("| name = "), t["role"], F.lit(" "), number), F.concat(F.lit("| cooldown = "), number, F.lit("/9 {{note}}")), F.concat(F.lit("| value1 = "), number, F.lit(".5 (+1)"))]
        lines += [F.concat(F.lit("| value2 alt = {{#vardefineecho:of"), number, F.lit("|"), number, F.lit("0}}")), F.concat(F.lit("| value3 = {{#var:"), t["role"], F.lit(" "), number, F.lit(" value1}}%"))]
        return F.concat_ws("\n", *lines)

    found = wiki.page_variables(_told(spark, sf_dir, turn).withColumn("text", F.concat(F.lit("| mana = 7\n"), "text", F.lit("\n| mana = 70"))))
    return found.select(F.col("title").alias("conv_id"), "name", "value")


def d19_records(spark, sf_dir):
    """Conversations as pages: turns as one part, of which those that hold a number have broken braces, and roles as another."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("title"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    broken = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("{{"), "role")).otherwise("{{fine}}")
    part = wiki.checked(turns.select("title", "turn", broken.alias("markup")), wiki.markup_error(F.col("markup"))).drop("markup")
    found = wiki.records(turns.select("title").distinct(), {"talents": part, "roles": turns.select("title", "role").distinct()})
    return found.select(F.col("title").alias("conv_id"), F.array_join(F.col("talents.turn").cast("array<string>"), ",").alias("turns"), F.col("_talents_parse_error").alias("error"), F.array_join("roles.role", ",").alias("roles"))


def e7_deep_nodes(spark, sf_dir):
    """Documents as objects nested one level deeper for each of sixteen remainders."""
    depth = (F.col("doc_id") % 16).cast("int")
    json = F.concat(F.repeat(F.lit('{"a":'), depth), F.lit('["'), F.col("doc_id").cast("string"), F.lit('"]'), F.repeat(F.lit("}"), depth))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("path"), json.alias("json"))
    return nodes.flatten(rows).select("doc_id", "path", F.col("item_no").cast("long").alias("item_no"), "text")


def g4_token_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("token_count"), F.lit("-1"))
    found = docs.select("doc_id", ingest.with_token_count(meta, F.col("text")).alias("m"))
    return found.select("doc_id", F.size("m").cast("long").alias("n_keys"), F.col("m")["source"].alias("source"), F.col("m")["token_count"].cast("long").alias("token_count"))


def a7_chunk_texts(spark, sf_dir):
    """Documents as lines of four shapes: with an id, one in the metadata, one to be put together, and a null one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    shapes = [
        F.to_json(F.struct(F.concat(F.lit("c"), (k % 100).cast("string")).alias("chunk_id"), "text")),
        F.to_json(F.struct(F.struct(F.concat(F.lit("m"), name).alias("id")).alias("metadata"), F.col("text").alias("content"))),
        F.to_json(F.struct(F.struct(F.lit("G").alias("game"), F.lit("").alias("hero"), F.lit("axe").alias("item"), k.alias("chunk_index")).alias("meta"), F.col("text").alias("page_content"))),
        F.concat(F.lit('{"chunk_id": null, "id": "x", "text": "t'), name, F.lit('"}')),
    ]
    line = F.when(k % 4 == 0, shapes[0]).when(k % 4 == 1, shapes[1]).when(k % 4 == 2, shapes[2]).when(k % 4 == 3, shapes[3])
    found = jsonl.chunk_texts(docs.select(F.lit("f").alias("file"), (k + 5).alias("line_no"), line.alias("line")))
    return found.select("chunk_id", F.md5("content").alias("content_md5"))


QUERIES = {f.__name__: f for f in (
    h4_bm25_topk, h1_tokens, h2_index_terms, h5_dense_topk, h6_filtered_topk, h8_merged_lists, h9_rrf_per_domain, h10_rrf_over_all, h12_counts,
    i9_gate, i11_context, i12_context_edges, i13_admitted, i15_context_text, j1_prompt, j8_abstentions, k5_claims, k7_faithfulness,
    l6_tiers, m10_rank_metrics, m13_summary, f1_findings, f4_counts, d3_plain_pages, e2_word_chunks, e3_recursive_chunks, e5_bundles, g2_normalised, g5_chunk_ids, b4_upsert, b4_buckets,
    d1_sections, d4_derived, d18_versions, e4_nested_nodes, m6_contexts, b3_report,
    h11_retrieval, i16_citations, i17_score_report, m9_list_metrics, m14_describe, j5_confidence, j6_overrides, j7_entities, a8_first_file, d16_guide, d16_builds, d16_items, d7_blocks, c2_variables, c10_references, d19_records, e7_deep_nodes, g4_token_metadata, a7_chunk_texts,
)}
