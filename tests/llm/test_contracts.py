"""Names, types and row counts of every registered query's result on small tables with nulls and repeats."""

import random

import pytest

import corpus_pipeline
from tessella.llm import common, queries

EXPECTED = {
    "op1_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_token_tables": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_quality_votes": {**dict.fromkeys(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "bigint"), "base_failed": "boolean", "kept": "boolean"},
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_token_rollup": {"source": "string", "lang": "string", "version": "string", "n_docs": "bigint", "n_tokens": "bigint"},
    "token_rollup_bpe": {"source": "string", "lang": "string", "version": "string", "n_docs": "bigint", "n_tokens": "bigint"},
    "op10_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_conversation_repair": {"conv_id": "bigint", **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "bigint"), "audit": "string", "repaired_sha256": "string"},
    "op13_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op12_merkle_manifest": {"doc_id": "bigint", **dict.fromkeys(["leaf", "subroot", "root", "proof_sha256", "folded_root"], "string"), "verified": "boolean"},
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(2, 9))) for _ in range(200)]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice((3, 40)))) + ".", rng.choice(["s1", "s2", None]), "en", 9) for k in range(60)]
    rows += [(70, None, None, None, None), (71, "", "s1", "en", 0), (72, rows[3][1], "s1", "en", 1), (73, "x " * 40_000, "s2", "en", 80_000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(rng.random() < 0.3)) for k in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(k // 4, k % 4 if k % 9 else None, ("user", "assistant")[k % 2], "Text. " * (k % 3)) for k in range(60)] + [(None, 1, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_every_query_has_a_contract():
    assert set(queries.QUERIES) == set(EXPECTED)


@pytest.mark.parametrize("name", EXPECTED)
def test_query(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in EXPECTED[name]} == EXPECTED[name]
    rows = out.collect()
    if name == "op11_conversation_repair":
        assert sorted((r.conv_id for r in rows), key=str) == sorted([*range(15), None], key=str)
    elif name not in ("op9_token_rollup", "token_rollup_bpe"):
        assert sorted(r.doc_id for r in rows) == sorted([*range(60), 70, 71, 72, 73])


def test_pipeline_keeps_the_tables_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clashing = docs.withColumns({c: docs["n_chars"] for c in ("shard", "slot_order", "piece_first", "digest", "quality", "component", "k", "name", "c", "root", "fps")})
    clashing = clashing.withColumns({f"tessella_{c}": docs["n_chars"] for c in ("quality", "id", "digest", "pieces", "piece", "words", "row")})
    out = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == clashing.columns
    assert dict(corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).dtypes)["ids_sha256"] == "string"


def test_pipeline_removes_what_it_stored(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda session: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["mix-sources"]
