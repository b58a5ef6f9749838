"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialise, new_path, remove, text_or_empty
from .components import connected_components
from .ngram_join import possible, repeated, shingle_set, shingled

BITS = 64
#: Shingles that are turned into bits at once; bounds the memory for a very long text.
_AT_ONCE = 1 << 15


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text as an unsigned integer; 0 if it has no words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, _AT_ONCE):
        first, last = starts[at : at + _AT_ONCE].tolist(), ends[at + width - 1 : at + width - 1 + _AT_ONCE].tolist()
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(first, last)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, digest, fp long) for every row; null and blank texts get fingerprint 0. The digest is the text's xxhash64."""

    def mapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    from pyspark.sql.functions import pandas_udf

    mapped.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), pandas_udf(mapped, "long")(text).alias("fp"))


def _masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of every choice of blocks that a pair within ``distance`` may have in common."""
    size = BITS // blocks
    block = [((1 << size) - 1) << (size * i) for i in range(blocks)]
    block[-1] |= ((1 << BITS) - 1) ^ sum(block)
    chosen = [sum(x) for x in combinations(block, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _flip_masks(mask: int) -> list[int]:
    """0 and every single bit outside ``mask``, as signed 64-bit values."""
    ones = [1 << i for i in range(BITS) if not (mask >> i) & 1]
    return [0] + [m - (1 << BITS) if m >> (BITS - 1) else m for m in ones]


def close_pairs(prints: DataFrame, distance: int = 2, blocks: int = 4, small: int = 32) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column ``fp``.

    ``blocks`` equal blocks are cut; fingerprints within ``distance`` share ``blocks - distance``
    of them, so each choice of that many blocks is a bucket key. Buckets of up to ``small`` members
    are joined to themselves and every pair is verified by its Hamming distance. In a larger bucket
    not all pairs are written out: two members within 2 bits have a common value at most one bit
    from either, so each member is listed under itself and each of its one-bit changes outside the
    bucket's blocks, and is linked to the smallest member listed there (a link that is verified
    too). That keeps every connection at a cost linear in the bucket. It needs ``distance`` 1 or 2.
    """
    if distance not in (1, 2):
        raise ValueError("distance has to be 1 or 2")
    masks = _masks(distance, blocks)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", key.alias("k")).select("fp", "k.choice", "k.key")
    sizes = materialise(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialise(keyed.join(sizes, ["choice", "key"]), "members")
    few = members.where(F.col("n") <= small)
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = few.select("choice", "key", F.col("fp").alias("a")).join(few.select("choice", "key", F.col("fp").alias("b")), ["choice", "key"]).where((F.col("a") < F.col("b")) & (differ <= distance)).select("a", "b")
    many = members.where(F.col("n") > small)
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in _flip_masks(m)]) for m in masks]), F.col("choice") + 1)
    listed = many.select("choice", "key", "fp", F.explode(flips).alias("flip")).select("choice", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    if distance == 1:  # a common neighbour proves 2 bits only: there, keep to the pairs of member and value that are both members
        listed = listed.join(many.select("choice", "key", F.col("fp").alias("near")), ["choice", "key", "near"])
        stars = listed.select(F.col("fp").alias("a"), F.col("near").alias("b"))
    else:
        first = materialise(listed.groupBy("choice", "key", "near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("choice", "key", "near", "a"), "nearest")
        stars = listed.join(first, ["choice", "key", "near"]).select("a", F.col("fp").alias("b"))
    stars = stars.where((F.col("a") != F.col("b")) & (differ <= distance))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row per input row: id, fp (long), component (smallest id that can be reached), root, digest.

    Equal fingerprints are linked, and so are those that differ in up to ``distance`` bits; null and
    blank texts share fingerprint 0. Rows with a null id take part, but a component's id is the
    smallest that isn't null (null if it has none). Repeated rows stay repeated. Other columns are
    not read. An empty table gives an empty result. Only distinct fingerprints are compared, and
    links, components and fingerprints stay in tables. ``root`` is a fingerprint of the component, the
    same for all of it, and ``digest`` the xxhash64 of the text.
    """
    prints = materialise(simhash(docs, id_col, text_col, shingle), "prints")
    heads = materialise(prints.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    parts = materialise(connected_components(close_pairs(heads, distance, blocks)), "parts")
    named = materialise(parts.join(heads.withColumnRenamed("fp", "node"), "node"), "named")
    least = materialise(named.groupBy("component").agg(F.min("head").alias("least")), "least")
    linked = named.join(least, "component").select(F.col("node").alias("fp"), "least", F.col("component").alias("root"))
    reach = materialise(heads.join(linked, "fp", "left").select("fp", F.coalesce("least", "head").alias("component"), F.coalesce("root", "fp").alias("root")), "reach")
    return prints.join(reach, "fp").select("id", "fp", "component", "root", "digest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates, with all their columns.

    The row with the smallest id stays, nulls last, then the one with the smallest text hash. Options
    are those of ``near_duplicates``. An empty table stays empty.
    """
    found = materialise(near_duplicates(docs, id_col, text_col, **options).select("id", "digest", "root"), "near-duplicates")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    best = materialise(found.groupBy("root").agg(F.min(first).alias("best")), "best")
    here = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.digest"))
    return keep_rows(docs, found.join(best, "root").where(here).select("id", "digest"), id_col, text_col)


#: Of ``near_copies``: fingerprints of a text, words of their features, blocks of each, bits in which all of a linked pair's may differ.
TABLES, FEATURE, BLOCKS, FARTHEST = 4, 2, 5, 56
#: Longs of the marks of a text's outline; a power of 2.
MARKS = 4


def wide_fingerprint(text: str, tables: int = TABLES, feature: int = FEATURE) -> np.ndarray:
    """SimHashes of a whole text's distinct features by ``tables`` seeds, as signed 64-bit integers."""
    hashes, out = shingle_set(text, feature), np.zeros(tables, np.uint64)
    for t in range(tables):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), _AT_ONCE):
            mixed = hashes[at : at + _AT_ONCE] + np.uint64(t * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(31)
            ones += np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        out[t] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose shingles' overlap is ``similarity`` percent of their union or more.

    Of ``n`` shingles of a text, ``shingles`` has those at least that another text has.
    """
    a, b = (sets.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(100 * F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``name`` is one of ``wanted``, and about one in sixteen of the others, told without a shuffle.

    The names' hashes are marked in bitmaps, which go to all tasks: two to four bytes a wanted name, 16 MB at most.
    """
    size = 1 << min(27, max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("name"), F.lit(size)) + 1
    marked = wanted.select(F.bitmap_bucket_number(place).alias("tessella_part"), F.bitmap_bit_position(place).alias("bit"))
    maps = materialise(marked.groupBy("tessella_part").agg(F.bitmap_construct_agg("bit").alias("tessella_bits")), "bitmaps")
    named = rows.withColumns({"tessella_part": F.bitmap_bucket_number(place), "tessella_bit": F.bitmap_bit_position(place)})
    byte = "cast(conv(hex(substring(tessella_bits, cast(tessella_bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    return named.join(F.broadcast(maps), "tessella_part").where(f"shiftright({byte}, cast(tessella_bit % 8 AS int)) & 1 = 1").select(*rows.columns)


def _marks(hashes: Column) -> Column:
    """``MARKS`` longs of 64 bits in which each hash sets one; the bits set are no more than the different hashes."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda i: lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(MARKS - 1)) == i
    return F.array(*[F.aggregate(F.filter(hashes, of(i)), F.lit(0).cast("long"), lambda s, h: s.bitwiseOR(bit(h))) for i in range(MARKS)])


def _outlined(open_rows: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``open_rows`` (c, largest, component, ...) with an outline of each text against a pivot, one text for each ``largest``.

    The pivot is the component's text with the most links. ``outline``: shingles of the pivot; of these those that the
    text has, and marks of the others; shingles that the text has besides, and their marks.
    """
    degrees = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("degree"))
    central = F.struct(F.col("component") == F.col("largest"), F.coalesce("degree", F.lit(0)))
    chosen = open_rows.join(degrees.hint("merge"), "c", "left").groupBy("largest").agg(F.max_by("c", central).alias("c"))
    pivots = materialise(chosen.join(sets.hint("merge"), "c").select("largest", F.col("shingles").alias("pivot")), "pivots")
    each = open_rows.select("c", "largest").distinct().join(sets.select("c", "shingles").hint("merge"), "c").join(pivots.hint("merge"), "largest")
    each = each.select("c", "largest", F.size("pivot").alias("of"), F.array_except("pivot", "shingles").alias("missing"), F.array_except("shingles", "pivot").alias("more"))
    outline = F.struct("of", (F.col("of") - F.size("missing")).alias("inside"), _marks(F.col("missing")).alias("missing"), F.size("more").alias("besides"), _marks(F.col("more")).alias("more"))
    return open_rows.join(materialise(each.select("c", "largest", outline.alias("outline")), "outlines").hint("merge"), ["c", "largest"])


def _may_overlap(similarity: int) -> Column:
    """Pairs that may be linked by their outlines ``oa`` and ``ob`` against the same pivot.

    What they have in common of the pivot is what neither misses, and of two sets' union there are as many
    hashes as bits of their marks at least.
    """
    oa, ob = F.col("oa"), F.col("ob")
    union = lambda field: sum((F.bit_count(F.get(oa[field], F.lit(i)).bitwiseOR(F.get(ob[field], F.lit(i)))) for i in range(MARKS)), F.lit(0))
    inside = F.least(oa["inside"], ob["inside"], oa["of"] - union("missing"))
    besides = F.least(oa["besides"], ob["besides"], oa["besides"] + ob["besides"] - union("more"))
    return (inside + besides) * (100 + similarity) >= similarity * (F.col("na") + F.col("nb"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80) -> DataFrame:
    """(id, digest, root) for every row: rows of one root are near copies, linked by similar sets of ``width``-word shingles.

    Texts meet that agree in two of the five blocks of one of four SimHashes of their word pairs. Under a common
    key each meets one of them, another one for each key; then texts of different components meet.
    Every pair is verified by its whole texts' shingles, so nothing is linked that isn't similar; a pair at the similarity
    itself may be missed (the README has shares). Equal texts are one; texts without words are linked with
    equal ones only. Null texts are empty. Repeated rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    from pyspark.sql.functions import pandas_udf

    def mapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([wide_fingerprint(t) for t in texts], dtype=object)

    def sliced(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in texts], dtype=object)

    for f in (mapped, sliced):
        f.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = text_or_empty(text_col)
    name = F.md5(text.cast("binary"))
    prints = materialise(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), name.alias("name"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"), pandas_udf(mapped, "array<long>")(text).alias("fps")), "prints")
    classes = materialise(prints.groupBy("name", "words").agg(F.any_value("fps").alias("fps")).withColumn("c", F.monotonically_increasing_id()), "texts")

    masks = _masks(BLOCKS - 2, BLOCKS)
    keyed = F.explode(F.array(*[F.struct(F.lit(t * len(masks) + i).alias("choice"), F.get("fps", F.lit(t)).bitwiseAND(F.lit(m)).alias("key")) for t in range(TABLES) for i, m in enumerate(masks)]))
    rows = classes.where("words").select("c", keyed.alias("k")).select("c", "k.choice", "k.key")
    heads = rows.groupBy("choice", "key").agg(F.min_by("c", F.xxhash64("c", "choice")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = materialise(rows.join(heads.hint("merge"), ["choice", "key"]), "keyed")

    def apart(t: int) -> Column:
        return F.get("pa", F.lit(t)).bitwiseXOR(F.get("pb", F.lit(t)))

    near = sum((F.bit_count(apart(t)) for t in range(TABLES)), F.lit(0)) <= FARTHEST
    earlier = [(F.col("choice") > t * len(masks) + i) & (apart(t).bitwiseAND(F.lit(m)) == 0) for t in range(TABLES) for i, m in enumerate(masks)]

    def with_texts(some: DataFrame) -> DataFrame:
        """(c, text) of some texts (c), read once more."""
        wanted = materialise(some.distinct().join(classes.select("c", "name").hint("merge"), "c"), "wanted")
        found = _among(docs.select(name.alias("name"), text.alias("text")), wanted).join(wanted.hint("merge"), "name")
        return found.groupBy("name", "c").agg(F.any_value("text").alias("text")).select("c", "text")

    once = rows.where("c <> head").select(F.least("c", "head").alias("a"), F.greatest("c", "head").alias("b")).distinct()
    x, y = (classes.select(F.col("c").alias(side), F.col("fps").alias(f"p{side}")).hint("merge") for side in "ab")
    met = materialise(once.join(x, "a").join(y, "b").where(near).select("a", "b"), "met")
    sets = with_texts(met.select(F.explode(F.array("a", "b")).alias("c"))).select("c", pandas_udf(sliced, "array<long>")("text").alias("shingles"))
    links = materialise(_verified(met, materialise(sets.select("c", F.size("shingles").alias("n"), "shingles"), "shingles"), similarity), "links")
    reach = materialise(connected_components(links), "reach")

    # texts of different components under one key; what shares too few shingles with all of these texts together is linked with none
    named = materialise(rows.drop("head").join(reach.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("component", F.coalesce("component", "c")), "named")
    several = named.groupBy("choice", "key", "component").agg(F.count("*").alias("k")).groupBy("choice", "key").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("different"))
    open_rows = materialise(named.join(several.where("different > 1").select("choice", "key", F.col("most.component").alias("largest")).hint("merge"), ["choice", "key"]), "open")
    if not open_rows.isEmpty():
        folder = new_path(docs.sparkSession, "open-sets")
        listed = shingled(with_texts(open_rows.select("c")), folder, "c", "text", width)
        left = materialise(repeated(listed, folder, similarity).dropDuplicates(["key"]), "repeated")
        remove(docs.sparkSession, folder)  # what is left of the sets is stored
        sets = materialise(listed.select(F.col("id").alias("c"), "key").join(left.hint("merge"), "key").select("c", "n", F.col("tokens").alias("shingles")), "alive")
        alive = sets.select("c", "n", F.size("shingles").cast("long").alias("s")).join(classes.select("c", "fps").hint("merge"), "c")
        open_rows = materialise(open_rows.join(alive.hint("merge"), "c"), "open-alive")
        open_rows = materialise(_outlined(open_rows, sets, links), "open-outlined")
        side = lambda x: [F.col("c").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("s").alias(f"r{x}"), F.col("fps").alias(f"p{x}"), F.col("outline").alias(f"o{x}")]
        rest = open_rows.where("component <> largest").select("choice", "key", *side("a"))
        every = open_rows.select("choice", "key", *side("b"), (F.col("component") == F.col("largest")).alias("in_largest"))
        # a pair counts under the first key that it shares, so it comes up once
        across = rest.join(every.hint("merge"), ["choice", "key"]).where("ca <> cb AND (in_largest OR a < b)").where(possible(similarity) & _may_overlap(similarity) & near & ~reduce(or_, earlier))
        pairs = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = materialise(_verified(pairs.join(met.hint("merge"), ["a", "b"], "left_anti"), sets, similarity), "more-links")
        if not more.isEmpty():
            reach = connected_components(links.unionByName(more))
    roots = materialise(classes.join(reach.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("name", F.coalesce("component", "c").alias("root")), "roots")
    return prints.join(roots.hint("merge"), "name").select("id", "digest", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each group of ``near_copies``, with all their columns: the smallest id, nulls last, then the smallest text hash."""
    found = materialise(near_copies(docs, id_col, text_col, **options), "near-copies")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    best = materialise(found.groupBy("root").agg(F.min(first).alias("best")), "best")
    here = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.digest"))
    return keep_rows(docs, found.join(best, "root").where(here).select("id", "digest"), id_col, text_col)
