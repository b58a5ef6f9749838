"""N-gram Jaccard join: which documents are linked by sets of shingles that overlap enough.

The order of all n-grams is cut into fragments. First, by ranges of their hashes, to tell which n-grams
occur in a single set only: these link nothing, and a document that has too many of them isn't read on. Then
the rest are ordered by how many sets hold them, rarest first. Sets that can be linked share an n-gram of
their first few; the overlaps of such pairs are counted in each fragment of the order separately and summed.

Equal sets are one class. A class meets the most central class under an n-gram before all others, so that
a large group of near copies is linked by about one pair a member; afterwards only pairs of different
components are counted, which loses no link between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import get_file, materialise, new_path, put_file, remove, text_or_empty
from .components import connected_components

#: N-grams of a file, and of a range of hashes; fragments of the order in which overlaps are counted.
CHUNK, RANGE, FRAGMENTS = 1 << 21, 1 << 22, 8
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles, A-Z in lower case; fewer words are one shingle, none give none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _MIX[0] + each[k : len(each) - size + 1 + k])
    return np.unique(out)


def shingled(docs: DataFrame, folder: str, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, key, n, chunk, tokens of the chunk): the sets go to files of about CHUNK hashes in ``folder``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, ids, sets, arrow = TaskContext.get().partitionId(), 0, 0, [], [], None

        def flush() -> pa.RecordBatch:
            chunk = (part << 33) + number
            tokens, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
            put_file(f"{folder}/{chunk}", np.int64(len(sets)).tobytes() + sizes.tobytes() + tokens.tobytes())
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            columns = [pa.array(ids, arrow), pa.array(keys, pa.binary()), pa.array(sizes), pa.array([chunk] * len(sets), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "chunk"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(one)
                sets.append(shingle_set(text.as_py(), width))
                held += len(sets[-1])
                if held >= CHUNK or len(sets) >= 1 << 16:
                    yield flush()
                    number, held, ids, sets = number + 1, 0, [], []
        if sets:
            yield flush()

    out = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(write, f"id {kind}, key binary, n long, chunk long")
    return materialise(out, "shingled")


def _read(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the sets, their hashes one after another) of a file."""
    data = get_file(f"{folder}/{chunk}")
    count = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, count, 8), np.frombuffer(data, np.uint64, offset=8 * (count + 1))


def repeated(listed: DataFrame, folder: str, least: int) -> DataFrame:
    """(key, n, tokens): sets of which ``least`` percent of the n-grams or more occur in other sets, too, and these n-grams.

    Every file sends the n-grams that it has, once each, as 32 bits behind the number of their range, and
    gets back a bit for each. N-grams that share these bits count as repeated; sets of one content, too:
    both only keep more than is needed.
    """
    chunks = listed.groupBy("chunk").agg(F.sum("n").alias("total"))
    total = listed.agg(F.sum("n")).first()[0] or 0
    bits = max(4, min(16, int(np.ceil(np.log2(max(1, total / RANGE))))))
    up, down = np.uint64(64 - bits), np.uint64(32 - bits)

    def distinct(folder: str, chunk: int) -> tuple:
        sizes, tokens = _read(folder, chunk)
        unique, counts = np.unique(tokens, return_counts=True)
        edges = np.searchsorted(unique >> up, np.arange((1 << bits) + 1, dtype=np.uint64))
        return sizes, tokens, unique, counts, edges

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in (int(c) for batch in batches for c in batch.chunk):
            _, _, unique, counts, edges = distinct(folder, chunk)
            short = (unique >> down).astype(np.uint32)
            for r in range(1 << bits):
                mine, many = short[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]] > 1
                yield pd.DataFrame({"range": [r], "chunk": [chunk], "once": [mine.tobytes()], "again": [mine[many].tobytes()]})

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(x, np.uint32) for x in rows.once]
        seen, counts = np.unique(np.concatenate([*once, *(np.frombuffer(x, np.uint32) for x in rows.again)]), return_counts=True)
        several = counts > 1
        return pd.DataFrame({"chunk": rows.chunk, "range": rows.range, "bits": [np.packbits(several[np.searchsorted(seen, x)]).tobytes() for x in once]})

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, tokens, unique, _, edges = distinct(folder, int(rows.chunk.iloc[0]))
        shared = np.zeros(len(unique), bool)
        for r, bits_of in zip(rows.range, rows.bits):
            shared[edges[r] : edges[r + 1]] = np.unpackbits(np.frombuffer(bits_of, np.uint8), count=edges[r + 1] - edges[r])
        flags = shared[np.searchsorted(unique, tokens)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sums = np.concatenate(([0], np.cumsum(flags)))
        alive = np.flatnonzero((sizes > 0) & (100 * (sums[ends] - sums[starts]) >= least * sizes))
        sets = [tokens[starts[i] : ends[i]] for i in alive]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        left = [s[flags[starts[i] : ends[i]]].view(np.int64) for i, s in zip(alive, sets)]
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "n": sizes[alive], "tokens": pd.Series(left, dtype=object)})

    dealt = chunks.select("chunk").repartition(max(1, min(4096, total // CHUNK + 1)), "chunk").mapInPandas(deal, "range int, chunk long, once binary, again binary")
    told = dealt.groupBy("range").applyInPandas(count, "chunk long, range int, bits binary")
    return told.groupBy("chunk").applyInPandas(keep, "key binary, n long, tokens array<long>")


def _needed(n: Column, least: int) -> Column:
    """The least overlap of a set of ``n`` with any partner."""
    return F.ceil(n * least / 100).cast("long")


def ordered(classes: DataFrame, least: int) -> DataFrame:
    """(c, n, listed): the n-grams of each class that others have as well, rarest first; classes with too few of them are left out."""
    each = classes.select("c", "n", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    together = each.join(held, "token").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("listed"))
    return together.where(F.size("listed") >= _needed(F.col("n"), least))


def _overlaps(pairs: DataFrame, segments: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are linked: overlaps counted in each fragment, then summed."""
    left = segments.select(F.col("c").alias("a"), "fragment", F.col("tokens").alias("of_a"))
    right = segments.select(F.col("c").alias("b"), "fragment", F.col("tokens").alias("of_b"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("of_a", "of_b")).alias("both"))
    sums = parts.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return sums.where(100 * F.col("both") >= least * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def possible(least: int) -> Column:
    """Pairs that may be linked by their sizes and by what is left of each from their first common n-gram on.

    ``ra`` and ``rb`` count the repeated n-grams from this one on; at a later common n-gram this may fail.
    """
    enough = F.least("ra", "rb") * (100 + least) >= least * (F.col("na") + F.col("nb"))
    return enough & (F.least("na", "nb") * 100 >= least * F.greatest("na", "nb"))


def linked_classes(classes: DataFrame, least: int) -> DataFrame:
    """(c, component) of the classes (c, n, tokens) that are linked with any."""
    spread = materialise(ordered(classes, least), "ordered")
    order = lambda x: x["df"] * (1 << 20) + F.shiftright(x["token"], 44)
    places = spread.select(F.explode(F.transform("listed", order)).alias("o"))
    pivots = places.agg(F.percentile_approx("o", [k / FRAGMENTS for k in range(1, FRAGMENTS)]).alias("p")).first().p or [0] * (FRAGMENTS - 1)

    def until(pivot: int) -> Column:
        return F.size(F.filter("listed", lambda x: order(x) <= pivot))

    cuts = spread.select("c", "listed", F.array(F.lit(0), *map(until, pivots), F.size("listed")).alias("cuts"))
    each = cuts.select("c", "listed", "cuts", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    size = F.get("cuts", F.col("fragment") + 1) - F.get("cuts", F.col("fragment"))
    segments = each.where(size > 0).select("c", "fragment", F.transform(F.slice("listed", F.get("cuts", F.col("fragment")) + 1, size), lambda x: x["token"]).alias("tokens"))
    segments = materialise(segments, "segments")

    s = F.size("listed").cast("long")
    first = s - _needed(F.col("n"), least) + 1  # n-grams of one set only come before all others in the order
    rows = spread.select("c", "n", s.alias("s"), F.posexplode(F.slice("listed", F.lit(1), first.cast("int"))).alias("i", "x")).select("c", "n", "s", (F.col("s") - F.col("i")).alias("r"), F.col("x.token").alias("token"))
    several = rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    rows = materialise(rows.join(several, "token"), "first-n-grams")

    # every class meets the most central one under each n-gram, largest share of repeated n-grams first
    heads = rows.groupBy("token").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), (-F.col("n")).alias("size"), "c", "n", "r")).alias("head"))
    met = rows.join(heads, "token").select(F.col("head.c").alias("a"), F.col("c").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"), F.col("head.r").alias("ra"), F.col("r").alias("rb"))
    pairs = materialise(met.where("a <> b").where(possible(least)).select("a", "b", "na", "nb").distinct(), "met")
    links = materialise(_overlaps(pairs, segments, least), "links")
    reach = materialise(connected_components(links), "reach")

    # then the members of all but the largest component under an n-gram meet all members of other ones
    named = materialise(rows.join(reach.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c")), "named")
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("different")).where("different > 1").select("token", F.col("most.component").alias("largest"))
    open_rows = materialise(named.join(mixed, "token"), "open")
    side = lambda x: [F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("r").alias(f"r{x}"), F.col("component").alias(f"c{x}")]
    rest = open_rows.where("component <> largest").select("token", *side("a"))
    every = open_rows.select("token", *side("b"), (F.col("component") == F.col("largest")).alias("in_largest"))
    across = rest.join(every, "token").where((F.col("ca") != F.col("cb")) & (F.col("in_largest") | (F.col("a") < F.col("b")))).where(possible(least))
    both = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(_overlaps(both.join(done, ["a", "b"], "left_anti"), segments, least), "more-links")
    if more.isEmpty():
        return reach.withColumnRenamed("node", "c")
    return connected_components(links.unionByName(more)).withColumnRenamed("node", "c")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, least: int = 85) -> DataFrame:
    """One row per input row: id, n (distinct shingles), component (smallest id that can be reached by links).

    Two documents are linked if their sets' overlap is ``least`` percent of their union or more. A text
    of fewer than ``width`` words has all of them as its one shingle; a null or blank one has none and is
    linked with nothing, its component is its own id. Rows with a null id take part, but a component's id
    is the smallest that isn't null (null if it has none). Repeated rows stay repeated. Other columns are not
    read; an empty table gives an empty result.
    """
    folder = new_path(docs.sparkSession, "shingle-sets")
    listed = shingled(docs, folder, id_col, text_col, width)
    alive = materialise(repeated(listed, folder, least).dropDuplicates(["key"]), "repeated")
    remove(docs.sparkSession, folder)  # what is left of the sets is stored
    classes = materialise(alive.withColumn("c", F.monotonically_increasing_id()), "classes")
    reach = linked_classes(classes, least)
    heads = materialise(listed.where("n > 0").groupBy("key").agg(F.min("id").alias("head")), "heads")
    named = materialise(classes.select("key", "c").join(reach, "c").join(heads, "key").select("key", "component", "head"), "named-classes")
    lowest = named.groupBy("component").agg(F.min("head").alias("lowest"))
    found = named.join(lowest, "component").select("key", "lowest")
    of_key = materialise(heads.join(found, "key", "left").select("key", F.coalesce("lowest", "head").alias("reached")), "of-key")
    return listed.join(of_key, "key", "left").select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("reached")).alias("component"))
