"""Mixing sources to target weights, by blocks of words.

The texts of a source, one behind another, are cut into blocks of a fixed number of words. A source
fills as many slots as it takes to reach its target; how many of them each output shard gets is
drawn at random. A source's slots are numbered through, and a pseudorandom permutation of its block
indices, another one each time round, says which block a slot gets. Slots and blocks meet in a join
by index. The last slot of a source takes only the words that are still due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialise, text_or_empty


def default_weight(k):
    """The weight of the source of rank ``k`` (a number or a column)."""
    return 1.0 + k % 3


def default_weights(names: list) -> list[float]:
    return [default_weight(k) for k in range(len(names))]


def targets_of(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Words per source: shares by weight of all sizes, at most ``most`` times the source's own.

    What a full source leaves goes to the others by weight, until none is above its bound.
    """
    found, active, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[k] for k in active)
        over = [k for k in active if rest * weights[k] / total > most * sizes[k]]
        for k in over or active:
            found[k] = most * sizes[k] if over else rest * weights[k] / total
        if not over:
            break
        rest -= sum(found[k] for k in over)
        active = [k for k in active if k not in set(over)]
    return found


def shard_counts(slots: int, shards: int, seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, counts): how many of a source's slots each shard gets, a multinomial draw; none are left out."""
    rng = np.random.default_rng([seed, k])
    if slots < shards:  # the same chances, without a number for every shard
        return np.unique(rng.integers(shards, size=slots), return_counts=True)
    drawn = rng.multinomial(slots, np.full(shards, 1 / shards))
    return np.flatnonzero(drawn), drawn[drawn > 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(size), by key, at ``index``; all are arrays of uint64.

    Four Feistel rounds on the least even number of bits that holds ``size``; values outside walk on.
    ``back`` inverts the permutation.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.uint64) + np.uint64(2)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            if back:
                left, right = right ^ (_mixed(left + _mixed(key[todo] + np.uint64((3 - r) * 0x9E37))) & m), left
            else:
                left, right = right, left ^ (_mixed(right + _mixed(key[todo] + np.uint64(r * 0x9E37))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _keys(k: np.ndarray, rounds: np.ndarray, seed: int) -> np.ndarray:
    """The permutations' keys by source and time round."""
    return (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (rounds.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed)


def slots_of(words: int, due: int, k: int, block_words: int, seed: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) of a source with ``words`` of which ``due`` are to be taken.

    Every time round takes all blocks once. All have ``block_words`` but the last, whose place in the
    last round tells how many slots that round needs.
    """
    blocks = -(-words // block_words)
    rounds, rest = divmod(due, words) if words else (0, 0)
    if not rest:
        return blocks, rounds * blocks, block_words
    short = blocks * block_words - words
    where = int(permuted(*(np.array([x], np.uint64) for x in (blocks - 1, blocks)), _keys(np.array([k]), np.array([rounds]), seed), back=True)[0])
    more = -(-rest // block_words)
    if where < more and more * block_words - short < rest:
        more += 1
    return blocks, rounds * blocks + more, rest - ((more - 1) * block_words - short * (where < more - 1))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank ``k`` by code point, null last; numbers of rows per partition come to the driver."""
    ordered = materialise(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    first = F.coalesce(*[F.when(part == p, F.lit(s)) for (p, _), s in zip(counts, starts)], F.lit(0))
    return ordered.select("source", "words", (F.col("at") - F.shiftleft(part, 33) + first).alias("k"))


def with_targets(sources: DataFrame, weight: Callable = default_weight, most: float = 3.0) -> DataFrame:
    """``sources`` (k, words) with ``target``, as ``targets_of`` gives it; two sums a round come to the driver."""
    w, bound = F.lit(1.0) * weight(F.col("k")), F.lit(most) * F.col("words")
    total = sources.agg(F.sum("words")).first()[0] or 0
    # the shares of those within their bounds are rest * weight / weights
    rest, weights, full = float(total), None, -1
    over = F.lit(False)
    while True:
        found = sources.agg(F.sum(F.when(over, bound)).alias("full"), F.sum(F.when(~over, w)).alias("weights"), F.count_if(over).alias("n")).first()
        if found.n == full or found.weights is None:
            break
        rest, weights, full = total - (found.full or 0.0), found.weights, found.n
        over = over | (F.lit(rest) * w / F.lit(weights) > bound)
    share = F.lit(rest) * w / F.lit(weights or 1.0)
    return sources.withColumn("target", F.when(over, bound).otherwise(share))


def plan_mix(sources: DataFrame, block_words: int, seed: int, weight: Callable = default_weight, most: float = 3.0) -> DataFrame:
    """(k, name, words, target, blocks, slots, last) of every source, by their names and words."""

    def planned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            due = [min(round(t), int(most * s)) for t, s in zip(p["target"], p["words"])]
            found = [slots_of(int(s), d, int(k), block_words, seed) for s, d, k in zip(p["words"], due, p["k"])]
            yield p.assign(**{c: [f[at] for f in found] for at, c in enumerate(("blocks", "slots", "last"))})

    targeted = with_targets(_ranked(sources), weight, most).select("k", F.col("source").alias("name"), "words", "target")
    return materialise(targeted.mapInPandas(planned, "k long, name string, words long, target double, blocks long, slots long, last long"), "plan")


def _pack(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their place in their source's words, (source, words) of every source)."""
    text = text_or_empty(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sized = materialise(sized, "sized")
    sources = materialise(sized.groupBy("source").agg(F.sum("size").alias("words")), "sources")
    # two levels of running sums, so that neither a hot source nor the rows of a bucket meet in one task
    buckets = max(1, int(np.sqrt(sized.count()) / 2))
    named = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "digest"), F.lit(buckets)))
    within = Window.partitionBy("source", "bucket").orderBy("id", "digest")
    placed = named.withColumns({"row": F.row_number().over(within), "within": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    placed = materialise(placed, "placed")
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = materialise(sums.select("source", "bucket", (F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("sum")).alias("before")), "buckets")
    same = placed["source"].eqNullSafe(before["source"]) & (placed["bucket"] == before["bucket"])
    rows = placed.join(before, same).select(placed["source"], placed["bucket"], "row", "id", "digest", "size", (F.col("before") + F.col("within")).alias("start"))
    return rows, sources


def _slots(plan: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """(shard, order, k, block, length) of every slot of the run."""
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // per_shard))

    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k, blocks, slots, last in zip(p["k"], p["blocks"], p["slots"], p["last"]):
                at, counts = shard_counts(int(slots), shards, seed, int(k))
                yield pd.DataFrame({"shard": at, "k": k, "first": np.cumsum(counts) - counts, "n": counts, "blocks": blocks, "slots": slots, "last": last})

    runs = plan.where("slots > 0").repartition("k").mapInPandas(drawn, "shard long, k long, first long, n long, blocks long, slots long, last long").repartition("shard", "k")
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    each = runs.select("shard", "k", "blocks", "slots", "last", slot)

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            slot, blocks, k = (p[c].to_numpy(np.uint64) for c in ("slot", "blocks", "k"))
            block = permuted(slot % blocks, blocks, _keys(k, slot // blocks, seed))
            length = np.where(p["slot"] + 1 == p["slots"], p["last"], np.iinfo(np.int64).max)
            yield pd.DataFrame({"shard": p["shard"], "k": p["k"], "slot": p["slot"], "block": block, "length": length})

    picked = each.mapInPandas(pick, "shard long, k long, slot long, block long, length long")
    return picked.select("shard", F.xxhash64(F.lit(seed), "shard", "k", "slot").alias("order"), "k", "block", "length")


@dataclass(frozen=True)
class Mix:
    """A planned mix. ``rows``: k, bucket, row, id, digest, size, start of every row of the input.
    ``pieces``: shard, order, k, block and, of every row with words in that slot, k, bucket, row,
    id, digest, first (word) and n (words). ``sources``: k, name, words, target, blocks, slots, last."""

    rows: DataFrame
    pieces: DataFrame
    sources: DataFrame

    @property
    def plan(self) -> pd.DataFrame:
        """``sources``, brought to the driver; a tool for looking at a mix."""
        return self.sources.orderBy("k").toPandas()


def mix_blocks(docs: DataFrame, block_words: int = 128, slots_per_shard: int = 4096, seed: int = 42, weight: Callable = default_weight, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan a mix of all rows of ``docs``; reruns with a seed agree.

    A source gets its target, rounded to words: each shard a share of its slots at random, about
    ``slots_per_shard`` of all sources, and no block is used more than ``most`` times, rounded up. A
    source's last block is as long as what is left, and so is its last slot. ``weight`` makes a column
    of weights from the column of ranks. Null and blank texts have no words, are in no block and are
    never taken; null is a source of its own, the last. Repeated rows count each for itself. Other
    columns are not read. An empty table gives a mix of nothing. Sources, slots and shards stay in tables.
    """
    placed, sources = _pack(docs, id_col, text_col, source_col)
    plan = plan_mix(sources, block_words, seed, weight, most)
    ranks = plan.select("k", "name")
    named = placed.join(ranks, placed["source"].eqNullSafe(ranks["name"]))
    rows = materialise(named.select("k", "bucket", "row", "id", "digest", "size", "start"), "rows")
    end = F.col("start") + F.col("size")
    covered = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start DIV {block_words}, (start + size - 1) DIV {block_words})")))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(end, (F.col("block") + 1) * block_words)
    spans = covered.select("k", "block", "bucket", "row", "id", "digest", (first - F.col("start")).alias("first"), (last - first).alias("n"), (first - F.col("block") * block_words).alias("skip"))
    # the slots come from a small list of runs, by which Spark would take them for small as well
    pieces = _slots(plan, slots_per_shard, seed).join(spans.hint("merge"), ["k", "block"]).withColumn("n", F.least("n", F.col("length") - F.col("skip")))
    return Mix(rows, pieces.where("n > 0").drop("length", "skip"), plan)


def taken_words(mix: Mix) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of the input."""
    taken = mix.pieces.groupBy("k", "bucket", "row").agg(F.sum("n").alias("taken"))
    out = mix.rows.join(taken, ["k", "bucket", "row"], "left").join(mix.sources, "k")
    return out.select("id", "size", F.col("words").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _words(text: Column) -> Column:
    """The words of a text, each with the white space behind it."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.split(bare, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")


def _taken_texts(docs: DataFrame, mix: Mix, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs``, one row per piece, whose words are its text, and a struct
    ``tessella_piece`` with the piece's shard, order and first word."""
    text = text_or_empty(text_col)
    wanted = mix.pieces.groupBy("id", "digest").agg(F.collect_list(F.struct("shard", "order", "first", "n")).alias("tessella_pieces"))
    wanted = wanted.select(F.col("id").alias("tessella_id"), F.col("digest").alias("tessella_digest"), "tessella_pieces")
    keyed = docs.withColumns({"tessella_id": F.col(f"`{id_col}`"), "tessella_digest": F.xxhash64(text)}).dropDuplicates(["tessella_id", "tessella_digest"])
    same = [keyed["tessella_digest"] == wanted["tessella_digest"], keyed["tessella_id"].eqNullSafe(wanted["tessella_id"])]
    joined = keyed.join(wanted, same[0] & same[1]).drop("tessella_id", "tessella_digest")
    split = joined.withColumn("tessella_words", _words(text))
    each = split.withColumn("tessella_piece", F.explode("tessella_pieces"))
    p = F.col("tessella_piece")
    piece = F.regexp_replace(F.array_join(F.slice("tessella_words", (p["first"] + 1).cast("int"), p["n"].cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    return each.select(*[piece.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], "tessella_piece")


def mixed_texts(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose words the mix takes, one per piece, with the piece for its text.

    Columns ``shard``, ``slot_order`` and ``piece_first`` are added, which sort the mix; they take the
    place of columns of ``docs`` with these names. Texts are moved once. Rows that repeat id and text
    stand for one another here: one of them lends its other columns.
    """
    p = F.col("tessella_piece")
    added = {"shard": p["shard"], "slot_order": p["order"], "piece_first": p["first"]}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return _taken_texts(docs, mix, id_col, text_col).select(*kept, *[v.alias(c) for c, v in added.items()])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix of ``docs`` as a table of the same columns: one row per piece, its words for its text.

    ``size_col`` gets the piece's code points. Options are those of ``mix_blocks``.
    """
    pieces = _taken_texts(docs, mix_blocks(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)
    length = F.length(text_col).cast("long")
    return pieces.select(*[length.alias(c) if c == size_col else F.col(f"`{c}`") for c in docs.columns])
