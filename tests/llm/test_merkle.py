"""Roots, proofs and tampering against a plain tree of lists."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, siblings of every leaf with their places, level by level)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            run = level[first : first + 3]
            paths[k].append((i - first, run[: i - first] + run[i - first + 1 :]))
        level, at = [h(level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def leaf(row):
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = {}, []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = tree([leaf(r) for r in by[s]])
    root, tops = tree([subs[s][0] for s in sources])
    for s, top in zip(sources, tops):
        for r, path in zip(by[s], subs[s][1]):
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            digest = leaf((*r[:4], text))
            for place, others in path + top:
                digest = h([*others[:place], digest, *others[place:]])
            proof = h(x for _, others in path + top for x in others)
            out.append((r[0], leaf(r), subs[s][0], root, proof, digest, digest == root))
    return out


def found(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    if extra:
        docs = docs.withColumns({c: F.lit(1) for c in ("id", "grp", "leaf", "at", "part", "row")})
    out = merkle.proofs(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    assert out.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and dict(out.dtypes)["id"] == "bigint"
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 1), (4, 2), (10, 9), (97, 1), (300, 40)])
def test_trees_of_all_shapes(spark, n, sources):
    rng = random.Random(n)
    names = [None, "", "é", "z", *(f"s{k}" for k in range(sources))][-sources:] if sources < 3 else [None, "", "é", "z", *(f"s{k}" for k in range(sources - 4))]
    rows = [(k * 7 % 1009, rng.choice(names), rng.choice(["en", None]), rng.choice([None, -5, k]), rng.choice([f"a\nb{k}", "plain", "", None])) for k in range(n)]
    assert found(spark, rows) == Counter(brute(rows))


def test_hot_sources_nulls_and_repeats(spark, monkeypatch):
    """Parts of a few leaves, merged two at a time: most nodes come about between parts."""
    monkeypatch.setattr(merkle, "PART_ROWS", 7)
    monkeypatch.setattr(merkle, "FAN", 2)
    rows = [(k, "hot" if k % 3 else f"s{k}", "en", k, f"t\n{k}") for k in range(90)] + [(None, "hot", None, None, None)] * 3
    rows += [(5, "hot", "en", 5, "t\n5")] * 20 + [(5, None, "en", 5, "other"), (2**60 + 1, "hot", "en", 1, "x" * 200_000 + "\n")]
    assert found(spark, rows, extra=True) == Counter(brute(rows))


def test_empty_table(spark):
    assert found(spark, []) == Counter()


def test_merging_is_associative():
    shape = merkle.Shape({0: 11, 1: 1, merkle.TOP: 2})
    leaves = {(0, 0, i): h([str(i)]) for i in range(11)} | {(1, 0, 0): h(["x"])}
    rng = random.Random(3)
    roots = set()
    for _ in range(20):
        parts = [{} for _ in range(4)]
        for node, digest in leaves.items():
            parts[rng.randrange(4)][node] = digest
        a, b, c, d = (merkle.merge({}, p, shape) for p in parts)
        out = merkle.merge(merkle.merge(a, b, shape), merkle.merge(c, d, shape), shape) if rng.random() < 0.5 else merkle.merge(d, merkle.merge(c, merkle.merge(b, a, shape), shape), shape)
        ((node, root),) = out.items()
        roots.add((node, root))
    assert len(roots) == 1
