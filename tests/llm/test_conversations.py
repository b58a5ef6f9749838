"""Faults and edits against plain Python: all cheapest edits by search, checked by trying out every short edit."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations

WHITE = " \t\n\x0b\x0c\r"
RIGHT = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind, role, text = zlib.crc32(":".join(told[:2]).encode()) % 20, told[2], told[3]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("B" if not bare else "D" if (role, text) in seen else "T" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edited(rows, found):
    """(cost, audit, repaired) by Dijkstra's order over (row, place), ties by audit."""
    import heapq

    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, place, text = heapq.heappop(heap)
        if at == len(rows) and place in (0, 3):
            return cost, audit, "\n".join(text)
        if (at, place) in done:
            continue
        done.add((at, place))
        role, then = ("assistant", 3) if place == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", at, then, text + (f"{role}:",)))
        if at < len(rows):
            extra = int(found[at] == "T")
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, place, text))
            if found[at] not in ("B", "D"):
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, then, text + (f"{role}:{rows[at][3]}",)))
                initial = rows[at][2][:1]
                if initial == role[0] or initial == "s" and place == 0:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, 1 if initial == "s" else then, text + (f"{rows[at][2]}:{rows[at][3]}",)))


def brute(rows):
    every, by = list(dict.fromkeys(r[0] for r in rows)), {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv in every:
        own = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found, turns = faults(own), {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = edited(own, found)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(found.count(x) for x in "BDT"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def repaired(spark, rows, extra=False):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        turns = turns.withColumns({c: F.lit(1) for c in ("conv", "at", "seg", "block", "digest", "b", "kind")})
    out = conversations.with_all(conversations.repair_conversations(conversations.damage(turns)), turns)
    rows = out.collect()
    assert len({r.conv for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def talks(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, rng.choice([f"Text {turn}.", "Same!", "no end", " \t", "", None, f"q{turn}? \n"])))
    return rows


def test_short_conversations(spark):
    rows = talks(random.Random(1), 300, 9) + [(None, 1, "user", "Null."), (None, None, None, None), (-1, 3, "user", "x." * 200_000)]
    got, expected = repaired(spark, rows, extra=True), brute(rows)
    assert {k: (got[k], v) for k, v in expected.items() if got[k] != v} == {} and set(got) == set(expected)


@pytest.mark.parametrize("bits", [1, 3])
def test_conversations_of_many_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = talks(random.Random(bits), 12, 70)
    rows += [(99, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(300) if k % 7] + [(99, 5, "user", "Same!")] * 30
    got, expected = repaired(spark, rows), brute(rows)
    assert {k: (got[k], v) for k, v in expected.items() if got[k] != v} == {}


def test_empty_table_and_conversations_that_vanish(spark):
    assert repaired(spark, []) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 1, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_the_search_finds_what_trying_everything_does():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(0, k, rng.choice(["system", "user", "assistant"]), rng.choice([f"{k}.", "open", " "])) for k in range(rng.randrange(4))]
        found, best = faults(rows), None
        for edits in itertools.product(*[["D", "K", "Ru", "Ra"]] * len(rows)):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                roles, audit, cost, ok = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0]), True
                for row, fault, edit, gap in zip(rows, found, edits, gaps[1:]):
                    ok &= edit == "D" or fault not in ("B", "D")
                    roles += {"D": "", "K": row[2][0], "Ru": "u", "Ra": "a"}[edit] + gap
                    cost += {"D": 3, "K": 0}.get(edit, 2) + (fault == "T" and edit != "D") + 2 * len(gap)
                    audit += edit[0] + "I" * len(gap)
                if ok and RIGHT.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
        assert edited(rows, found)[:2] == best
