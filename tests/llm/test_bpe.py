import random

import pyarrow as pa
import pytest
import regex
import tiktoken

from tessella.llm import bpe, pieces

PATH = pieces.vocabulary_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def table():
    return bpe.PrefixBpe(pieces.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=pieces.default_pattern(), mergeable_ranks=pieces.read_ranks(PATH), special_tokens={})


def odd_texts(n=400, seed=1):
    rng = random.Random(seed)
    alphabet = list("aeiouthnds  \n\t'.,123ÄéßñABC") + ["'s", "'re", "  ", " the", "<|endoftext|>", "中文", "😀", " ", " ", "\x1c", "\x85"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)] + ["", " ", "\n", "   ", "a" * 5000, " " * 3000, "=" * 700 + "\n" * 300]


def test_texts_encode_as_the_library_does(table, library):
    encoder, texts = bpe._encoder(PATH, pieces.default_pattern())[1], odd_texts()
    for some in (texts, texts[::-1], texts[:1], []):
        ids, ends = encoder.batch(pa.array(some, pa.string()).slice(0))
        for text, a, b in zip(some, ends, ends[1:]):
            expected = library.encode_ordinary(text)
            assert ids[a:b].tolist() == expected, repr(text)
            assert table.decode(expected) == text.encode()


def test_any_bytes_encode_as_the_library_does(table, library):
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choices(b"aetion \xc3\xa9\xff\x00th", k=rng.randrange(1, 80)))
        assert table.encode(piece) == library._encode_single_piece(piece)


def test_pieces_are_split_alike_at_every_code_point(library):
    split = regex.compile(pieces.default_pattern())
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or (c > 0x3000 and c % 97):
            continue
        text = f"a1{chr(c)}b 2 {chr(c)}"
        ours = [x.encode() for x in split.findall(text)]
        assert sum((library._encode_single_piece(p) for p in ours), []) == library.encode_ordinary(text), hex(c)


def test_edits_and_appends_are_exact_and_local(table, library):
    rng = random.Random(3)
    for text in odd_texts(60, 4):
        state = bpe.EncodedText(table, text)
        for more in odd_texts(6, rng.random()):
            more = more[:50]
            a, b = sorted((rng.randrange(len(state.text) + 1), rng.randrange(len(state.text) + 1)))
            expected = state.text[:a] + more + state.text[b:]
            state.replace(a, b, more)
            assert state.text == expected and state.ids() == library.encode_ordinary(expected)
            state.append(more)
            assert state.ids() == library.encode_ordinary(expected + more)
    long = bpe.EncodedText(table, "some words of text " * 500)
    before = long.computed
    long.replace(4000, 4003, "xyz")
    assert long.computed - before < 8 and long.ids() == library.encode_ordinary(long.text)


def test_spark_round_trip_and_edits(spark, library):
    rows = [(1, "The cat's  hat\n", "x"), (2, None, "x"), (3, "", "y"), (None, "été", None), (1, "The cat's  hat\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_documents(docs, PATH, decoded=True).collect()
    assert sorted((r.id or 0, r.ids, bytes(r.decoded)) for r in out) == sorted((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    again = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted((t or "").encode() for _, t, _ in rows)
    edits = spark.createDataFrame([(1, 4, 7, "dog"), (1, 15, 15, "end"), (3, 0, 0, "new")], "id long, start int, end int, new string")
    got = {r.text: r.ids for r in bpe.edit_documents(docs, edits, PATH).collect()}
    assert got == {t: library.encode_ordinary(t) for t in ("The dog's  hat\nend", "new")}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
