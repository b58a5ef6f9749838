import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import components, simhash


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\tÄé. ", max_size=60))
def test_fingerprint_is_that_of_the_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(7)
    text = " ".join(rng.choices("abcdefghij", k=simhash._AT_ONCE + 5000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_close_pairs_keep_every_connection(spark):
    rng = random.Random(1)
    values = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((2, 10, 120))):
            values.add(x)
            y = x
            for _ in range(rng.randrange(4)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
            x = y if rng.random() < 0.3 else x
    values = sorted(map(signed, values))
    links = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for small in (4, 10_000):
        got = {(r.a, r.b) for r in simhash.close_pairs(prints, small=small).collect()}
        assert {tuple(sorted(p)) for p in got} <= links
        assert small == 4 or {tuple(sorted(p)) for p in got} == links
        assert reach(got, values) == reach(links, values)
    near = {p for p in links if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") == 1}
    for small in (2, 10_000):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.close_pairs(prints, distance=1, blocks=3, small=small).collect()}
        assert got == near


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    edges += [tuple(rng.sample(range(1000, 1100), 2)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in components.connected_components(df).collect()} == reach([e for e in edges if e[0] != e[1]], nodes)
    assert components.connected_components(df.limit(0)).count() == 0


def test_documents_with_nulls_repeats_and_odd_texts(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("the of cat dog tree runs Home".split(), k=rng.choice((1, 2, 40, 300)))) for _ in range(40)]
    texts = base + [b + " more" for b in base] + [None, "", " \n", "cat", "CAT"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z"), (None, "cat", "z"), (None, "lonely one here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    keys = sorted({f for _, f in prints})
    root = reach([(a, b) for a in keys for b in keys if a < b and bin(a ^ b).count("1") <= 2], keys)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(map(str, ((i, signed(f), least.get(root[f])) for i, f in prints))) == sorted(str((r.id, r.fp, r.component)) for r in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def planted(rng, words, length, changed):
    own = rng.choices(words, k=length)
    copy = list(own)
    for at in rng.sample(range(length), changed):
        copy[at] = rng.choice(words)
    return " ".join(own), " ".join(copy)


def five(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_are_found_and_verified(spark):
    """Of pairs with a similarity of 0.88 to 0.92 nine in ten are linked, of those at 0.8 to 0.84 most; nothing below 0.8 is."""
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(900):
        one, other = planted(rng, words, *[(300, 3), (300, 6), (120, 2), (120, 4)][k % 4])
        pairs.append((2 * k, 2 * k + 1, len(five(one) & five(other)) / len(five(one) | five(other))))
        rows += [(2 * k, one), (2 * k + 1, other)]
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    root, members = {r.id: r.root for r in found}, {}
    for r in found:
        members.setdefault(r.root, set()).add(r.id)
    assert all(len(m) == 1 or m in [{a, b} for a, b, _ in pairs] for m in members.values())
    linked = lambda low, high: [root[a] == root[b] for a, b, s in pairs if low <= s < high]
    assert not any(linked(0, 0.8)) and len(linked(0, 0.8)) > 20
    for low, high, least in ((0.88, 0.93, 0.9), (0.8, 0.85, 0.75)):
        share = linked(low, high)
        print(low, len(share), sum(share) / len(share))
        assert len(share) > 100 and sum(share) / len(share) >= least


def test_groups_around_the_similarity_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Variants of one text with words of each other's: what is verified after the first links grows with the members, and no link is lost."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(2, 9))) for _ in range(400)]
    base, few = rng.choices(words, k=150), [(at, word) for at in rng.sample(range(150), 30) for word in rng.choices(words, k=2)]
    rows = []
    for k in range(700):
        own = list(base)
        for at, word in rng.sample(few, rng.choice((2, 3, 4, 5, 6))):
            own[at] = word
        rows.append((k, " ".join(own)))
    verified, counts = simhash._verified, []

    def counted(pairs, sets, similarity):
        pairs = pairs.cache()
        counts.append(pairs.count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "_verified", counted)
    found = {r.id: r.root for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    monkeypatch.setattr(simhash, "_may_overlap", lambda similarity: F.lit(True))
    plain = {r.id: r.root for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    together = lambda roots: {frozenset(k for k in roots if roots[k] == r) for r in set(roots.values())}
    assert together(found) == together(plain) and 1 < len(together(found)) < 650
    assert len(counts) == 4 and 4 * counts[1] < counts[3], counts


def test_near_copies_edge_cases(spark):
    base = " ".join(f"w{k}" for k in range(60))
    group = [(100 + k, base.replace(f"w{k % 50} ", f"x{k} ")) for k in range(120)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (None, base), (5, base), (5, base)] + group
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "c", "name", "digest", "root")})
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5)]
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_texts_that_are_read_again_are_told_without_a_shuffle(spark):
    rows = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("name"), F.col("id").alias("text"))
    wanted = rows.where("text % 20 = 3").select("name", F.col("text").alias("c"))
    kept = simhash._among(rows, wanted)
    assert kept.join(wanted, "name").count() == 2000 and 2000 <= kept.count() < 6000
    assert kept.columns == rows.columns and "hashpartitioning" not in kept._jdf.queryExecution().toString()
    assert simhash._among(rows, wanted.limit(0)).count() == 0
