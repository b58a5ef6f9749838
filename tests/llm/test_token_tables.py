import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import common, pieces, queries, token_tables
from tessella.llm.pieces import vocabulary_path
from tests.llm.test_bpe import odd_texts

PATH = vocabulary_path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_texts_encode_as_the_library_does():
    t, texts = library(), odd_texts()
    ids, ends = token_tables.library_encoder(PATH).batch(pa.array(texts).slice(3))
    for text, a, b in zip(texts[3:], ends, ends[1:]):
        assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_shard_keeps_and_finds_every_document():
    rng = random.Random(5)
    ids = sorted(rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)) + [7 << 60, 7 << 60, None]
    values = [np.array([rng.randrange(50_000) for _ in range(rng.choice((0, 1, 5, 400)))], "<u4") for _ in ids]
    values[3] = np.arange(60_000, dtype="<u4")
    out = io.BytesIO()
    writer = token_tables.ShardWriter(out, 2)
    for i, v in zip(ids, values):
        writer.add(i, v)
    assert writer.close() == (len(ids), sum(map(len, values)))
    reader = token_tables.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    read = list(reader)
    assert [i for i, _ in read] == ids and all(np.array_equal(a, b) for (_, a), b in zip(read, values))
    for i, v in zip(ids[:-3], values):
        assert [x.tolist() for x in reader.get(i)] == [v.tolist()]
    assert len(reader.get(7 << 60)) == 2 and len(reader.get(None)) == 1 and reader.get(12345) == []
    assert sum(reader.may_hold(rng.randrange(1 << 40)) for _ in range(2000)) < 100


def test_spark_tables(spark):
    texts = odd_texts(120, 9)
    rows = [(k * 3 % 101 - 20, t, 1) for k, t in enumerate(texts)] + [(None, "a b", 2), (5, None, 3), (900, "same", 1), (900, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    manifest = token_tables.write_shards(docs, common.new_path(spark, "sst"), PATH, 2)
    got = token_tables.read_shards(manifest).collect()
    t = library()

    def crc(ids):
        return zlib.crc32(np.array(ids, "<u4").tobytes())

    expected = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, _ in rows]
    assert sorted((str(i), len(x), crc(x)) for i, x in expected) == sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted((i for i in order if i is not None)) + [None]
    assert [x.tolist() for x in token_tables.look_up(manifest, [900])[900]] == [t.encode("same").ids + [2]] * 2
    assert token_tables.token_tables(docs.limit(0), PATH, 2).count() == 0


def test_added_tokens_are_those_of_the_unchanged_library(spark, tmp_path):
    t, texts = Tokenizer.from_file(PATH), [*odd_texts(), "a<|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>\n", "<|endof text|> c"]
    assert sum(50256 in t.encode(x, add_special_tokens=False).ids for x in texts) > 50
    for some in (texts, texts[-4:], ["plain words"]):
        ids, ends = token_tables.library_encoder(PATH, added_tokens=True).batch(pa.array(some))
        for text, a, b in zip(some, ends, ends[1:]):
            assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    docs = [(k, x) for k, x in enumerate(texts[-4:])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op4_token_tables(spark, str(tmp_path)).collect()}
    expected = {k: t.encode(x, add_special_tokens=False).ids + [2] for k, x in docs}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in expected.items()}


def test_what_does_not_fit_raises(spark):
    writer = token_tables.ShardWriter(io.BytesIO(), 2)
    with pytest.raises(ValueError, match="70000"):
        writer.add(1, np.array([5, 70_000], "<u4"))
    wide = token_tables.ShardWriter(out := io.BytesIO(), 4)
    wide.add(1, np.array([5, 70_000], "<u4"))
    wide.close()
    assert token_tables.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue())).get(1)[0].tolist() == [5, 70_000]
    with pytest.raises(ValueError, match="whole numbers"):
        token_tables.token_tables(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH, 2)


def test_words_are_remembered_up_to_a_bound():
    asked = []

    def encode_words(words):
        asked.append(len(words))
        return [len(w).to_bytes(4, "little") * (len(w) % 3) for w in words]

    encoder = pieces.CachedEncoder(encode_words, lambda texts: [b"\7\0\0\0"] * len(texts))
    batches = [pa.array(["head " + " ".join(f"w{k}" for k in range(at, at + 50_000)), "head same" + " long" * 3 + " " + "y" * 50]) for at in range(0, 500_000, 50_000)]
    for _ in range(2):
        for number, batch in enumerate(batches):
            ids, ends = encoder.batch(batch)
            words = [f"w{k}" for k in range(number * 50_000, number * 50_000 + 50_000)]
            told = [7] + [len(w) for w in words for _ in range(len(w) % 3)], [7] + [4] * 4 + [50] * 2
            assert ids.tolist() == told[0] + told[1] and ends.tolist() == [0, len(told[0]), len(ids)]
    assert sum(asked) == 500_000 + 3 + 2 * len(batches)  # all once, but for the word that is too long
    for at in range(1_000_000, 1_200_000, 50_000):
        encoder.batch(pa.array(["head " + " ".join(f"w{k}" for k in range(at, at + 50_000))]))
    asked.clear()
    encoder.batch(pa.array(["head " + " ".join(f"w{k}" for k in range(1_100_000, 1_200_000))]))
    assert not asked and len(encoder._words) <= pieces.REMEMBERED and len(encoder._table) <= 8 * pieces.REMEMBERED
