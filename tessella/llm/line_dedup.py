"""Lines that documents share, found by a sharded minimal perfect hash.

The distinct keys of lines, as 128-bit hashes, are dealt to shards. A shard is a minimal perfect
hash with three arrays in its order: fingerprints, numbers of documents, and the smallest document
(the owner). Documents' line hashes are sent to their shard's arrays; no line is joined to another.
A shard that many lines ask for, such as that of a line in a third of all documents, is asked by
several tasks, each of which loads its arrays.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import WHITE_SPACE, get_file, materialise, new_path, put_file, text_or_empty
from .pieces import slices

SHORTEST, DOCUMENTS = 10, 2
#: Keys of a shard, about; the number of shards follows from it.
KEYS_PER_SHARD = 1 << 16
#: Stands for a null identifier where one has to stand; what it stands for is told by a column beside it.
NO_ID = (1 << 63) - 1


def key_of(line: str) -> str:
    """The line without white space at its ends, with A-Z in lower case (as UTF-8 lower-cases ASCII)."""
    line = line.strip(WHITE_SPACE)
    return line.lower() if line.isascii() else line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def line_hash(key: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct unsigned 64-bit numbers, by levels of bit arrays.

    On each level a number takes a bit of an array twice as long as the numbers left; those alone on
    their bit stay there, the others go on to the next level. The index is the number of set bits
    before: each number of the set has one of its own below the set's size. What isn't in the set
    gets any index, or -1.
    """

    def __init__(self, sizes: list[int], words: list[np.ndarray]):
        """Of each level the number of its bits, and the bits in words of 64."""
        self.sizes, self.words = sizes, words
        counts = [np.bitwise_count(w).astype(np.uint32) for w in words]
        self._base = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self._before = [np.cumsum(c, dtype=np.uint32) - c for c in counts]

    @classmethod
    def build(cls, numbers: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], np.asarray(numbers, np.uint64)
        while len(left):
            if len(words) > 200:
                raise ValueError("the numbers aren't distinct")
            size = max(64, -(-2 * len(left) // 64) * 64)
            spot = (_mixed(left, len(words)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[spot]]
        return cls(sizes, words)

    def __len__(self) -> int:
        return int(self._base[-1])

    def index(self, numbers: np.ndarray) -> np.ndarray:
        found, todo, one = np.full(len(numbers), -1, np.int64), np.arange(len(numbers)), np.uint64(1)
        for level, (size, words, before) in enumerate(zip(self.sizes, self.words, self._before)):
            if not len(todo):
                break
            spot = _mixed(numbers[todo], level) % np.uint64(size)
            word, bit = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
            bits = words[word]
            here = (bits >> bit & one).astype(bool)
            below = np.bitwise_count(bits[here] & ((one << bit[here]) - one))
            found[todo[here]] = self._base[level] + before[word[here]] + below
            todo = todo[~here]
        return found


class LineShard:
    """The arrays of one shard, stored as a whole: fingerprints and counts of 32 bits, owners of 64."""

    def __init__(self, table: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.table, self.prints, self.counts, self.owners = table, prints, counts, owners

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> LineShard:
        """``high`` and ``low`` are the halves of the hashes; halves that collide are folded apart."""
        table = PerfectHash.build(_folded(high, low))
        at = table.index(_folded(high, low))
        shard = cls(table, np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64))
        shard.prints[at], shard.counts[at], shard.owners[at] = _print(low), np.minimum(counts, 2**32 - 1), owners
        return shard

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) for each hash; count 0 for one that the shard doesn't hold."""
        at = self.table.index(_folded(high, low))
        if not len(self.prints):
            return np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
        known = (at >= 0) & (self.prints[at] == _print(low))
        return np.where(known, self.counts[at], 0), self.owners[at]

    def dump(self) -> bytes:
        out = io.BytesIO()
        levels = {f"level{k}": x for k, x in enumerate(self.table.words)}
        np.savez(out, sizes=np.array(self.table.sizes, np.int64), prints=self.prints, counts=self.counts, owners=self.owners, **levels)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineShard:
        with np.load(io.BytesIO(data)) as f:
            sizes = f["sizes"].tolist()
            return cls(PerfectHash(sizes, [f[f"level{k}"] for k in range(len(sizes))]), f["prints"], f["counts"], f["owners"])


def _print(low: np.ndarray) -> np.ndarray:
    return (low.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _folded(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) ^ (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST) -> DataFrame:
    """(id, digest, high, low) for each different line key of each row that has ``shortest`` code points."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 2, 1024)):
            rows, digests = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                found = {line_hash(k) for k in {key_of(line) for line in text.split("\n")} if len(k) >= shortest}
                rows += [row] * len(found)
                digests += found
            halves, rows = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["id", "digest", "high", "low"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(hashed, f"id {id_type}, digest long, high long, low long")


def build_shards(lines: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write the arrays of each shard to ``folder`` and return (shard, path, keys)."""
    counted = lines.groupBy("high", "low").agg(F.count("*").alias("rows"), F.count("id").alias("named"), F.min("id").alias("owner"), F.max("id").alias("last"))
    # rows of one identifier, or of none, are one document; where several hold a line, its rows are
    # counted, and one of them has an identifier, so that the owner is known
    one = F.col("owner").isNull() | ((F.col("owner") == F.col("last")) & (F.col("named") == F.col("rows")))
    counted = counted.withColumn("n", F.when(one, F.lit(1)).otherwise(F.col("rows")))
    dealt = counted.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), "high", "low", "n", F.coalesce(F.col("owner").cast("long"), F.lit(NO_ID)).alias("owner"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        table = LineShard.build(*(part[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low")), part["n"].to_numpy(np.int64), part["owner"].to_numpy(np.int64))
        path = f"{folder}/lines-{shard:08d}.npz"
        put_file(path, table.dump())
        return pd.DataFrame({"shard": [shard], "path": [path], "keys": [len(part)]})

    return dealt.groupBy("shard").applyInPandas(build, "shard int, path string, keys long")


def probe_shards(lines: DataFrame, folder: str, shards: int, documents: int = DOCUMENTS) -> DataFrame:
    """The rows (id, digest, high, low) whose line some other, smaller document holds, by the shards' arrays.

    Rows come to a task shard by shard and stream past that shard's arrays. The rows of a shard are
    rebalanced: adaptive execution gives those of a hot one to several tasks.
    """
    id_type = dict(lines.dtypes)["id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for batch in batches:
            shard, high, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3, 4))
            none = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard[a] != at:
                    at, table = shard[a], LineShard.load(get_file(f"{folder}/lines-{shard[a]:08d}.npz"))
                count, owner = table.probe(high[a:b].view(np.uint64), low[a:b].view(np.uint64))
                gone = np.flatnonzero((count >= documents) & (none[a:b] | (owner != ids[a:b]))) + a
                if len(gone):
                    part = pa.RecordBatch.from_arrays(batch.columns[1:], ["id", "digest", "high", "low"])
                    yield part.take(pa.array(gone))

    dealt = lines.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), "id", "digest", "high", "low")
    return dealt.hint("rebalance", F.col("shard")).sortWithinPartitions("shard").mapInArrow(probe, f"id {id_type}, digest long, high long, low long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row: its lines but those it shares with a smaller id.

    A line's key is the line stripped of white space, A-Z in lower case. Keys of ``shortest`` or more
    code points that ``documents`` or more documents hold stay in the smallest of these only, with all
    their lines there. Null and empty texts are one empty line. Rows of one identifier are one
    document; null is one, behind all others. Identifiers are whole numbers; others raise ValueError.
    Other columns are not read; an empty table gives an empty result.

    What is gone is grouped by row, that is by identifier and text, so that neither a repeated nor a
    null identifier gathers lines of many rows.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"the identifiers in {id_col} aren't whole numbers")
    lines = line_hashes(docs, id_col, text_col, shortest)
    lines = materialise(lines, "line-hashes")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, folder = max(4 * partitions, -(-lines.count() // KEYS_PER_SHARD)), new_path(spark, "line-shards")
    # with two documents it is enough that the smallest and the largest identifier differ
    once = lines if documents <= 2 else lines.select("id", "high", "low").distinct()
    materialise(build_shards(once, folder, shards), "shards")
    gone = probe_shards(lines, folder, shards, documents)
    gone = materialise(gone.groupBy("id", "digest").agg(F.collect_set(F.struct("high", "low")).alias("gone")), "gone-lines")

    id_type = docs.schema[id_col].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_lines", "n_dropped", "text"]
        for batch in (part for b in batches for part in slices(b, 1, 1024)):
            counts, texts = [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                all_lines = text.split("\n")
                drop = {np.array((x["high"], x["low"]), "<i8").tobytes() for x in gone or ()}
                kept = [x for x in all_lines if not (drop and len(k := key_of(x)) >= shortest and line_hash(k) in drop)]
                counts.append((len(all_lines), len(all_lines) - len(kept)))
                texts.append("\n".join(kept))
            n = np.array(counts, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy()), pa.array(texts, pa.string())], names)

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    named = gone.withColumnsRenamed({"id": "gone_id", "digest": "gone_digest"})
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    joined = rows.join(named, same, "left").select("id", "text", "gone")
    return joined.mapInArrow(keep, f"id {id_type}, n_lines long, n_dropped long, text string")
