"""Links and components against all pairs."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm import ngram_join

LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, width=4, least=85):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and group[a] != group[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    group = [group[b] if g == group[a] else g for g in group]
    ids = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return Counter((r[0], len(s), ids[g]) for r, s, g in zip(rows, sets, group))


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "n", "chunk", "c", "token")})
    out = ngram_join.jaccard_components(docs.repartition(3), **options)
    assert out.columns == ["id", "n", "component"]
    return Counter(map(tuple, out.collect()))


def corpus(rng, texts, copies, most):
    words = ["".join(rng.choices("abcdefghinostu", k=rng.randrange(2, 8))) for _ in range(900)]
    passage = rng.choices(words, k=60)
    rows = []
    for k in range(texts):
        own = rng.choices(words, k=rng.choice([3, 5, 30, 80, 200]))
        if k % 3 == 0:
            own = passage + own
        for _ in range(rng.choice(copies)):
            changed = list(own)
            for _ in range(rng.randrange(most)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((len(rows) * 7 % 4001, rng.choice([" ", "\n"]).join(changed)))
    return rows


def test_components_of_near_copies(spark):
    rng = random.Random(2)
    rows = corpus(rng, 60, (1, 2, 6), 5)
    rows += [(4001 + k, t) for k, t in enumerate([None, "", " \n", "One two", "one TWO", "one  two", "two one", "É é x y", "é é x y"])]
    rows += [(None, rows[3][1]), (None, "alone as can be here"), (rows[5][0], rows[5][1]), (5000, "long " * 3000 + "x"), (5001, "long " * 3000 + "y")]
    assert found(spark, rows) == brute(rows)


def test_a_chain_under_a_hot_passage(spark, monkeypatch):
    """Many members of one group, each near its neighbours only, in files of a few sets."""
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    rows, text = [], rng.choices(words, k=120)
    for k in range(90):
        rows.append((k, " ".join(text)))
        text[rng.randrange(120)] = rng.choice(words)
    base = rng.choices(words, k=50)
    for k in range(120):
        changed = list(base)
        for _ in range(k % 4):
            changed[rng.randrange(50)] = f"n{rng.randrange(9999)}"
        rows.append((1000 + k, " ".join(changed)))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, width=2, least=60) == brute(rows, 2, 60)


def test_thresholds_at_the_edge(spark):
    """17 of 20 n-grams are 85 percent, 16 of 19 are less."""
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words[:20])), (2, " ".join(words[:23])), (3, " ".join(words[10:23])), (4, " ".join(words[7:23]))]
    rows += [(10 + k, " ".join(f"{k}v{i}" for i in range(20))) for k in range(3)] + [(20, " ".join(f"0v{i}" for i in range(22)))]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == Counter()


def test_files_of_which_nothing_is_left(spark):
    """Sets that share nothing: each file keeps none of them."""
    rows = [(k, f"only{k} words{k} of{k} this{k} one{k}") for k in range(9)]
    assert found(spark, rows) == brute(rows)
