import random
import re

import numpy as np
import pytest

from tessella.llm import mixing


def test_targets_share_everything_within_the_bounds():
    assert mixing.targets_of([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets_of([1000, 10, 10], [1, 2, 3]) == [960, 30, 30]
    assert mixing.targets_of([0, 0], [1, 2]) == [0, 0] and mixing.targets_of([], []) == []
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice((0, 1, 10, 1000)) for _ in range(rng.randrange(1, 9))]
        got = mixing.targets_of(sizes, mixing.default_weights(sizes))
        assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes)) and sum(got) == pytest.approx(sum(sizes))


def test_permutations_are_permutations():
    for size in (1, 2, 3, 7, 64, 65, 1000):
        for key in (0, 1, 2**63):
            n = np.full(size, size, np.uint64)
            got = mixing.permuted(np.arange(size, dtype=np.uint64), n, np.full(size, key, np.uint64))
            assert sorted(got) == list(range(size))
            assert (mixing.permuted(got.astype(np.uint64), n, np.full(size, key, np.uint64), back=True) == np.arange(size)).all()
    a, b = (mixing.permuted(np.arange(1000, dtype=np.uint64), np.full(1000, 1000, np.uint64), np.full(1000, k, np.uint64)) for k in (1, 2))
    assert (a == b).sum() < 20 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.1


def test_draws_are_whole_and_random():
    for slots, shards in ((3000, 100), (40, 100), (0, 5), (7, 1)):
        at, counts = mixing.shard_counts(slots, shards, 7, 3)
        assert counts.sum() == slots and (np.diff(at) > 0).all() and (counts > 0).all() and (at < shards).all()
        again = mixing.shard_counts(slots, shards, 7, 3)
        assert (at == again[0]).all() and (counts == again[1]).all()
    assert 4 < mixing.shard_counts(3000, 100, 7, 3)[1].std() < 7
    a, b = (mixing.shard_counts(3000, 100, 7, k)[1] for k in (1, 2))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.4


def test_slots_take_what_is_due():
    rng = random.Random(9)
    for _ in range(300):
        words, block = rng.randrange(1, 400), rng.choice((1, 7, 16, 128))
        due = rng.randrange(3 * words + 1)
        k = rng.randrange(9)
        blocks, slots, last = mixing.slots_of(words, due, k, block, 42)
        length = lambda b: min(block, words - b * block)
        index = np.arange(slots, dtype=np.uint64)
        got = mixing.permuted(index % max(blocks, 1), np.full(slots, blocks, np.uint64), mixing._keys(np.full(slots, k), index // max(blocks, 1), 42))
        taken = [length(b) for b in got.tolist()]
        if taken:
            assert 0 < last and (taken[-1] >= last or last == block)
            taken[-1] = min(taken[-1], last)
        assert sum(taken) == due


def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        source = rng.choice(["a", "b", "é", None, "a", "a"])
        out.append((i, rng.choice([None, "", " \n", "x"]) if i % 9 == 0 else "".join(f"w{i}_{j}" + rng.choice((" ", "\n", "\t ")) for j in range(rng.choice((3, 40, 700)))), source, "c"))
    return out + [out[5], out[5], (None, "with no id", "b", "c"), (None, None, None, "c")]


def test_mix_keeps_the_targets_and_the_bounds(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, target string")
    mix = mixing.mix_blocks(docs, block_words=16)
    got = mixing.taken_words(mix).collect()
    again = mixing.taken_words(mixing.mix_blocks(docs.repartition(7), block_words=16)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.id), r["size"]) for r in got) == sorted((str(i), count(t)) for i, t, *_ in data)
    names = sorted({s for *_, s, _ in data if s}) + [None]
    sizes = [sum(count(t) for _, t, s, _ in data if s == n) for n in names]
    targets = dict(zip(sizes, mixing.targets_of(sizes, mixing.default_weights(names))))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == targets[r.source_size] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
    for size, n in taken.items():
        assert abs(n - targets[size]) <= 16 + 0.01 * targets[size]


def test_pieces_are_the_taken_words(spark):
    docs = spark.createDataFrame(rows()[:-4], "doc_id long, text string, source string, target string")
    mix = mixing.mix_blocks(docs, block_words=16)
    taken = {r.id: r.taken for r in mixing.taken_words(mix).collect()}
    texts = {i: t or "" for i, t, *_ in rows()}
    found = dict.fromkeys(taken, 0)
    slots = {}
    for r in mixing.mixed_texts(docs, mix).collect():
        assert r.text in texts[r.doc_id] and r.text == r.text.strip()
        found[r.doc_id] += len(r.text.split())
        slots[r["shard"], r.slot_order] = slots.get((r["shard"], r.slot_order), 0) + len(r.text.split())
    assert found == taken and max(slots.values()) == 16
    assert len(slots) == mix.plan.slots.sum()
    empty = mixing.mix_blocks(docs.limit(0))
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_texts(docs.limit(0), empty).count() == 0


def test_many_small_sources_reach_their_targets(spark):
    rng = random.Random(12)
    data = [(k, " ".join(["w"] * rng.randrange(1, 301)), f"s{k:04d}", 1) for k in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, shard int")
    got = mixing.taken_words(mixing.mix_blocks(docs)).collect()
    assert len(got) == 1000
    sizes = [len(t.split()) for _, t, *_ in data]
    targets = mixing.targets_of(sizes, mixing.default_weights(sizes))
    for r in got:
        assert r.target == targets[r.id] and abs(r.taken - r.target) <= 0.51 and r.taken <= 3 * r["size"]


def test_columns_with_the_names_of_helpers_stay(spark):
    names = ["shard", "slot_order", "piece_first", "digest", "quality", "order", "k", "block"]
    docs = spark.createDataFrame([(i, t, s, *range(8)) for i, t, s, _ in rows()[:60]], ["doc_id", "text", "source", *names])
    got = mixing.mixed_documents(docs, block_words=16)
    assert got.columns == docs.columns and {tuple(r[3:]) for r in got.collect()} == {tuple(range(8))}
    assert mixing.mixed_texts(docs, mixing.mix_blocks(docs)).count() > 0


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "a"), (2, "x", "a"), (3, "y " * 1000, "b")], "doc_id long, text string, source string")
    mix = mixing.mix_blocks(docs)
    taken = {r.id: (r.taken, r.target) for r in mixing.taken_words(mix).collect()}
    assert taken[1][0] + taken[2][0] == round(taken[1][1]) and taken[3][0] == 3000
    assert sum(len(r.text.split()) for r in mixing.mixed_texts(docs, mix).collect()) == 201_001
