"""The pipeline's stages against brute force on a small table."""

import hashlib
import random
import re
from collections import Counter

import tiktoken

import corpus_pipeline
from tessella.llm import mixing, ngram_join, pieces, quality
from tessella.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def table(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnoprstuw", k=rng.randrange(2, 9))) for _ in range(400)]
    text = lambda: ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(rng.randrange(4, 12))) + "."
    rows = [(k, text(), "en", f"s{k % 4}", k) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(" ", "\n", 3), "en", "s0", 1) for k in range(10)]  # equal but for white space
    rows += [(200 + k, rows[k][1] + " More.", "en", None, 1) for k in range(10)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, "# # # $ $ % | " * 30, "en", "s1", 0), (None, text(), "en", "s2", 1), (5, rows[5][1], "en", "s1", 5)]
    return materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "pipeline-test")


def as_rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_stages_are_those_of_brute_force(spark):
    docs = table(spark)
    before, stages = as_rows(docs), dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mix sources", "byte-level bpe"]

    good = materialise(stages["quality rules"](spark, docs, ""), "t")
    assert good.columns == docs.columns
    judged = quality.assess(docs).collect()
    model = quality.fit(Counter(tuple(r.quality["votes"]) for r in judged if not r.quality["base_failed"]))
    expected = Counter((r.doc_id, r.text, r.lang, r.source) for r in judged if not r.quality["base_failed"] and model.log_odds(r.quality["votes"]) >= 0)
    assert as_rows(good) == expected and sum(expected.values()) == sum(before.values()) - 3

    exact = materialise(stages["exact dedup"](spark, good, ""), "t")
    groups = {}
    for row in sorted(as_rows(good), key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0, str(r))):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1]), row[:2])
    assert sorted((str(r.doc_id), r.text) for r in exact.collect()) == sorted((str(i), t) for i, t in groups.values())

    near = materialise(stages["simhash near-dedup"](spark, exact, ""), "t")
    rows = [(r.doc_id, set(ngram_join.shingle_set(r.text or "", 5).tolist())) for r in exact.collect()]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(rows[a][1] & rows[b][1]) >= 80 * len(rows[a][1] | rows[b][1]) > 0 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    stays = {min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if group[k] == g) for g in set(group)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == sorted(stays)

    mixed = materialise(stages["mix sources"](spark, near, ""), "t")
    assert mixed.columns == docs.columns
    taken = {r.id: r.taken for r in mixing.taken_words(mixing.mix_blocks(near)).collect()}
    words, texts = Counter(), {r.doc_id: re.findall(WORD, r.text) for r in near.collect()}
    for r in mixed.collect():
        own = re.findall(WORD, r.text)
        words[r.doc_id] += len(own)
        assert r.n_chars == len(r.text) and any(texts[r.doc_id][i : i + len(own)] == own for i in range(len(texts[r.doc_id])))
    assert {k: v for k, v in taken.items() if v} == dict(words)

    library = tiktoken.Encoding("own", pat_str=pieces.default_pattern(), mergeable_ranks=pieces.read_ranks(pieces.vocabulary_path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for r in mixed.collect():
        ids = library.encode_ordinary(r.text)
        expected[r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(r.text.encode())] += 1
    got = Counter(map(tuple, stages["byte-level bpe"](spark, mixed, "").collect()))
    assert got == expected


def test_empty_table(spark):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "t")
    assert docs.count() == 0
