"""The registered queries of the corpus operators, their digests and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, credentials, exact_dedup, line_dedup, merkle, mixing, ngram_join, quality, simhash, token_rollup, token_tables, toxicity
from .common import WORD, documents, materialise, new_path
from .pieces import vocabulary_path
from .sql import CONVERSATION_REPAIR, MERKLE_MANIFEST


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.tiktoken"), decoded=True)
    return token_digests(out)


def token_digests(encoded: DataFrame) -> DataFrame:
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken_words(mixing.mix_blocks(documents(spark, sf_dir)))
    return out.withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), cosines=False)  # ids of the evidence only
    held_out = F.crc32(F.col("id").cast("string")) % 5 == 0
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("evidence.id").alias("nearest"))


def op4_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_tables.token_tables(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), end_id=2, added_tokens=True)
    return out.withColumnRenamed("id", "doc_id")


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("doc_id", *[F.col(f"quality.{c}") for c in [*quality.BASE, "base_failed", "kept"]])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha256").alias("text_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = credentials.find_secrets(documents(spark, sf_dir))

    def named(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in credentials.BASE]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(credentials.in_order(F.concat("base", "linked"))).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Versions of op9's tokenizer: words, and runs of letters, of digits and single other characters.
TOKENIZERS = {"words-1": WORD, "pieces-1": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
MARKUP = r"[#*$%&|<>]"


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after their load by both versions, a recount of the texts without
    markup, the removal of what is under ten words long, and a second try of each batch. Texts are read once."""
    plain, words = F.regexp_replace("text", MARKUP, ""), token_rollup.pattern_count("text", WORD)
    marked = F.coalesce(F.col("text").rlike(MARKUP), F.lit(False)) & (words >= 10)
    before = {v: token_rollup.pattern_count("text", p).alias(v) for v, p in TOKENIZERS.items()}
    after = [F.when(marked, token_rollup.pattern_count(plain, p)).alias(f"plain {v}") for v, p in TOKENIZERS.items()]
    counts = materialise(documents(spark, sf_dir).select("source", "lang", (words < 10).alias("short"), marked.alias("marked"), *before.values(), *after), "counts")

    def counted(rows: DataFrame, of: str = "") -> DataFrame:
        return token_rollup.counted(rows, {v: F.col(f"`{of}{v}`") for v in TOKENIZERS})

    rollup = token_rollup.TokenRollup(spark, new_path(spark, "token-rollup"))
    batches = {
        "load": token_rollup.inserts(counted(counts)),
        "short documents": token_rollup.deletes(counted(counts.where("short"))),
        "markup": token_rollup.revisions(counted(counts.where("marked")), counted(counts.where("marked"), "plain ")),
    }
    for batch, changes in [*batches.items(), *batches.items()]:
        rollup.commit(batch, changes)
    rollup.compact()
    return rollup.totals()


def token_rollup_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup by op1's vocabulary: the load of all documents, then the removal of those under ten words, each tried twice."""
    docs, path = documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.tiktoken")
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "token-rollup"))
    short = docs.where(token_rollup.pattern_count("text", WORD) < 10)
    for batch, changes in [("load", token_rollup.inserts(token_rollup.bpe_counted(docs, "bpe-50k", path))), ("short documents", token_rollup.deletes(token_rollup.bpe_counted(short, "bpe-50k", path)))] * 2:
        rollup.commit(batch, changes)
    return rollup.totals()


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.repair_conversations(conversations.damage(turns))
    return conversations.with_all(found, turns).withColumnRenamed("conv", "conv_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle.proofs(documents(spark, sf_dir), tampered, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return out.withColumnRenamed("id", "doc_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_token_tables": op4_token_tables,
    "op5_quality_votes": op5_quality_votes,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secrets": op7_secrets,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_rollup": op9_token_rollup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_join": op13_ngram_join,
    "token_rollup_bpe": token_rollup_bpe,
}

ORACLE_SQL = {
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id
            FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
    "op8_line_dedup": r"""
        WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM a),
        k AS (
            SELECT doc_id, i, line,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l),
        s AS (
            SELECT key, min(doc_id) AS owner FROM k
            GROUP BY key HAVING length(key) >= 10 AND count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.*, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_token_rollup": r"""
        WITH d AS (
            SELECT source, lang, coalesce(text, '') AS text,
                   regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g') AS plain
            FROM documents),
        n AS (
            SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS old_words FROM d),
        t AS (
            SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(plain, '[^\x20\x09-\x0D]+')) AS tokens
            FROM n WHERE old_words >= 10
            UNION ALL
            SELECT source, lang, 'pieces-1', len(regexp_extract_all(plain, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))
            FROM n WHERE old_words >= 10)
        SELECT source, lang, version, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
        FROM t GROUP BY source, lang, version""",
}
