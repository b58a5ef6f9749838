import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best = min(groups[norm])
        out.append((i, best[3], len(groups[norm]), i == best[3] and len(t) == -best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(str, out))


def rows():
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefghitl é😀", k=rng.choice((0, 3, 700, 9000)))) for _ in range(60)]
    texts = base + [b.replace(" ", " \n") for b in base[:30]] + base[:20] + [None, "", " \t\n\x0b\x0c\r", " ", " "]
    return [(i * 7 % 113, t, "x", "y") for i, t in enumerate(texts)] + [(None, base[0], "x", "y"), (None, "only", "x", "y"), (3, "twice", "", ""), (3, "twice", "", "")]


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda c: F.length(c).cast("long") % 7])
def test_groups_are_those_of_equal_normalised_texts(spark, hashed):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, recipe string, keep string")
    got = exact_dedup.exact_duplicates(docs, hashed=hashed).collect()
    assert sorted(str((r.id, r.keep, r["size"], r.kept, r.sha256)) for r in got) == expected(rows())
    assert exact_dedup.exact_duplicates(docs.limit(0), hashed=hashed).count() == 0


def test_chunks_make_up_the_text_and_follow_its_content(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghitlmnopqrs", k=60_000))
    docs = spark.createDataFrame([(0, long), (1, "new head " + long), (2, "z" * 10_000), (3, "ü" * 5_000)], "k int, text string")
    got = {r.k: r.c for r in docs.select("k", exact_dedup.chunks(exact_dedup.normalised(F.col("text"))).alias("c")).collect()}
    assert "".join(got[0]) == long and "".join(got[2]) == "z" * 10_000 and "".join(got[3]) == "ü" * 5_000
    assert max(map(len, got[0])) <= exact_dedup.LONGEST + 2
    assert len(set(got[0]) & set(got[1])) > len(got[0]) / 2
