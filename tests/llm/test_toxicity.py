import math
import random
import zlib
from collections import Counter

import numpy as np

from tessella.llm import toxicity


def terms(text):
    words = Counter("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    found = Counter()
    for w, n in words.items():
        found[w] += n
        for k in (4, 5, 6, 7):
            if len(w) > k:
                found[w[:k] + "*"] += n
    return found


def brute_force(rows, labels):
    """(vectors over all terms, {id: label}) of whole texts."""
    texts = [terms(t) for _, t in rows]
    df = Counter(t for x in texts for t in x)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) for t, n in df.items()}
    vectors = []
    for x in texts:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in x.items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / size for t, w in v.items()} if size else {})
    return vectors


def cosine(a, b):
    return sum(w * b[t] for t, w in a.items() if t in b)


def table():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeghilnorst", k=rng.randrange(2, 10))) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice((3, 30, 90))))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "12 34"), (403, "zzzzqqqq yyyyxxxx"), (404, rows[7][1]), (None, rows[8][1]), (9, rows[9][1])]
    rows += [(405, "onlyhere " + " ".join(words[:9])), (406, "onlyhere " + " ".join(f"q{k}uuu".replace(str(k), chr(97 + k % 26) * 3) for k in range(60)))]
    labels = [(k, int(rng.random() < 0.4)) for k in range(0, 290, 2)] + [(405, 1), (4, None), (None, 1), (9999, 1)]
    return rows, labels


def test_neighbours_and_cosines_are_those_of_a_full_scan(spark):
    rows, labels = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = {r.id: r.toxic for r in toxicity.example_sample(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "toxic").collect()}
    vectors = brute_force(rows, labels)
    first = {}
    for (i, _), v in zip(rows, vectors):
        first.setdefault(i, v)
    examples = {i: first[i] for i in sample if i in first}
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and Counter(r.id for r in got) == Counter(i for i, _ in rows)
    by_id = {r.id: r for r in got}
    for (i, _), v in zip(rows, vectors):
        near = sorted(((-round(cosine(v, e), 6), k) for k, e in examples.items() if cosine(v, e) > 1e-7))[: toxicity.EVIDENCE]
        evidence = by_id[i].evidence
        assert np.allclose([e.cosine for e in evidence], [-c for c, _ in near], atol=2e-6), i
        assert all(abs(cosine(v, examples[e.id]) - e.cosine) < 1e-6 and sample[e.id] == e.toxic for e in evidence)
    assert by_id[404].score == by_id[7].score and by_id[None].score == by_id[8].score
    assert len({by_id[i].score for i in (400, 401, 402, 403)}) == 1 and not by_id[403].evidence


def test_a_word_of_one_example_and_the_rest_of_a_text_count(spark):
    rng = random.Random(4)
    plain = ["amber", "birch", "cedar", "delta", "ember"]
    rows = [(k, " ".join(rng.choices(plain, k=6))) for k in range(40)]
    labels = [(k, k % 2) for k in range(1, 40)]
    own = next(k for k, _ in labels if zlib.crc32(str(k).encode()) % 5)
    rows[own] = (own, "fnordling")
    rows += [(100, "fnordling"), (101, "fnordling " + " ".join(f"{a}{b}xyz" for a in "pqrstuvw" for b in "pqrstuvw"))]
    got = {r.id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [e.id for e in got[100].evidence] == [own] and abs(got[100].evidence[0].cosine - 1) < 1e-9
    assert [e.id for e in got[101].evidence] == [own] and got[101].evidence[0].cosine < 0.2


def test_tables_without_labels_or_rows(spark):
    rows, labels = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in ([], [(k, 1) for k, _ in labels if k is not None], [(k, 0) for k, _ in labels if k is not None]):
        got = toxicity.score_toxicity(docs, spark.createDataFrame(some, "doc_id long, toxic int")).collect()
        assert len(got) == len(rows) and len({r.score for r in got}) == 1 and not any(r.evidence for r in got)
    assert toxicity.score_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_blocks_stop_late_enough(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    terms = [np.sort(rng.choice(60, rng.integers(1, 12), replace=False)) for _ in range(200)]
    counts = [rng.integers(1, 4, len(t)) for t in terms]
    terms[50], counts[50] = terms[10], counts[10]
    idf = rng.random(60)
    index = toxicity.BlockMaxIndex(np.arange(200), np.arange(200) % 2, terms, counts, idf)
    dense = np.zeros((200, 60))
    for k, (t, c) in enumerate(zip(terms, counts)):
        dense[k, t] = index.weights(t, c)
    for k in range(200):
        for without in (None, int(np.flatnonzero(index.ids == k)[0])):
            found, cosines = index.nearest(terms[k], index.weights(terms[k], counts[k]), 7, without)
            full = dense @ dense[k]
            best = sorted((-round(c, 6), i) for i, c in enumerate(full) if c > 1e-7 and not (without is not None and i == k))[:7]
            assert [int(i) for i in index.ids[found]] == [i for _, i in best]
            assert np.allclose(cosines, [-c for c, _ in best], atol=2e-6)


def test_scores_and_evidence_are_the_same_without_cosines(spark):
    rows, labels = table()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = {(str(r.id), r.score, tuple((e.id, e.toxic) for e in r.evidence)) for r in toxicity.score_toxicity(docs, known).collect()}
    assert kept == {(str(r.id), r.score, tuple((e.id, e.toxic) for e in r.evidence)) for r in toxicity.score_toxicity(docs, known, cosines=False).collect()}
    none = toxicity.score_toxicity(docs, known.limit(0), cosines=False)
    assert none.schema["evidence"].dataType.elementType.names == ["id", "toxic"] and none.count() == len(rows)


def test_other_columns_long_texts_and_string_ids(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeghil", k=5)) for _ in range(80)]
    rows = [(f"d{k}", " ".join(rng.choices(words, k=20)), 1, 2.0, "x") for k in range(60)] + [("long", " ".join(rng.choices(words, k=300_000)), 0, 0.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, toxic int, score double, term string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame([(f"d{k}", k % 2) for k in range(60)], "doc_id string, toxic int"), most=20, neighbours=5).collect()
    assert len(got) == 61 and all(0 <= r.score <= 1 and r.evidence for r in got)


def test_the_sample_takes_toxic_labels_first(spark):
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1000)], "doc_id long, toxic int")
    known = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 5]
    toxic = sum(k % 10 == 0 for k in known)
    for most in (40, 400, 5000):
        got = toxicity.example_sample(labels, "doc_id", "toxic", most).collect()
        assert len(got) == min(most, len(known)) and sum(r.toxic for r in got) == min(toxic, max(most // 2, most - (len(known) - toxic)))
        assert {r.id for r in got} <= set(known) and all(r.toxic == (r.id % 10 == 0) for r in got)
