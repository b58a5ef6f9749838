import random

import numpy as np
import pytest

from tessella.llm import line_dedup

WS = " \t\n\x0b\x0c\r"


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        numbers = rng.integers(0, 2**63, n, np.uint64)
        table = line_dedup.PerfectHash.build(numbers)
        assert len(table) == n and sorted(table.index(numbers)) == list(range(n))


def test_shards_tell_what_they_hold():
    rng = np.random.default_rng(2)
    high, low = rng.integers(0, 2**63, (2, 3000), np.uint64)
    counts, owners = rng.integers(1, 9, 3000), rng.integers(-5, 10**12, 3000)
    shard = line_dedup.LineShard.load(line_dedup.LineShard.build(high, low, counts, owners).dump())
    n, owner = shard.probe(high, low)
    assert (n == counts).all() and (owner == owners).all()
    other = rng.integers(0, 2**63, (2, 3000), np.uint64)
    assert not shard.probe(other[0], other[1])[0].any()
    empty = line_dedup.LineShard.load(line_dedup.LineShard.build(*np.zeros((4, 0), np.uint64)).dump())
    assert not empty.probe(high, low)[0].any()


def slow(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))

    ids = [line_dedup.NO_ID if i is None else i for i, *_ in rows]
    holders = {}
    for i, (_, t, *_) in zip(ids, rows):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, (original, t, *_) in zip(ids, rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((original, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def test_lines_stay_where_they_come_first(spark):
    rng = random.Random(4)
    pool = ["A line that is shared", " a LINE that is shared\t", "short", "123456789", "1234567890", "Ünïcode línes élan", "ÜNÏCODE línes élan", "", "  ", "only   spaces inside"]
    rows = [(rng.randrange(80), "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own line {rng.randrange(400)} here" for _ in range(rng.randrange(12))), "g") for _ in range(150)]
    rows += [(i, "the very common line of all\n" + t, "g") for i, t, _ in rows] + [(None, pool[0], "g"), (None, pool[0] + "\nown null line text", "g"), (-7, None, "g"), (90, "", "g"), (91, "x" * 100_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted(str((r.id, r.n_lines, r.n_dropped, r.text)) for r in got) == slow(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_null_and_largest_identifiers_are_documents_of_their_own(spark):
    largest = (1 << 63) - 1
    rows = [(largest, "a line both of them hold"), (None, "a line both of them hold\nother"), (None, "only in rows without id\nx"), (None, "only in rows without id\ny")]
    rows += [(None, f"a hot line in every row\nrow {k} of many null ones") for k in range(300)] + [(5, "A hot line in every row ")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.id is None, r.id or 0, r.text, r.n_dropped) for r in got)
    expected = [(False, 5, "A hot line in every row ", 0), (False, largest, "a line both of them hold", 0), (True, 0, "other", 1), (True, 0, "only in rows without id\nx", 0), (True, 0, "only in rows without id\ny", 0)]
    assert found == sorted(expected + [(True, 0, f"row {k} of many null ones", 1) for k in range(300)])


def test_three_documents_and_repeated_identifiers(spark):
    rows = [(1, "shared by two of them\nshared by all three"), (1, "shared by two of them"), (2, "shared by two of them\nshared by all three"), (3, "shared by all three")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string"), documents=3).collect()
    assert sorted((r.id, r.text) for r in got) == [(1, rows[1][1]), (1, rows[0][1]), (2, "shared by two of them"), (3, "")]


def test_identifiers_that_are_not_numbers_raise(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        line_dedup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
