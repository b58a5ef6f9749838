"""Conversation structure repair: faults, and the cheapest edits that give a conversation whose roles alternate.

A conversation is right if it is empty or its roles' initials are ``(s?(ua)+)?``. A fold over its sorted turns
carries four (cost, audit) structs, one for each place in that pattern: nothing yet, after s, after u, after a.
A conversation of any length is cut into blocks of the sorted table. Each block is folded from every place
it may begin at, and a second fold joins the blocks, so that no task holds the turns of a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a block, as a power of two.
BLOCK_BITS = 8
#: Costs of editing a turn's role, of deleting it, of inserting one, and of keeping a truncated one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 40
LEGAL = ("su", "ua", "au")
_STATES = "array<struct<cost:bigint,audit:string>>"
_PATH = "struct<cost:bigint,audit:string,path:array<struct<seg:bigint,place:int,letters:string>>>"
_WHITE = r"\x20\x09-\x0D"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults by the crc32 of ``conv:turn`` modulo 20: 0 is dropped, 1 has no text, 2 no ``[.!?]``, 3 comes twice, 4 is the user's. Nulls read as one space."""

    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind, role, text = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col))) % 20, told(role_col), told(text_col)
    out = turns.withColumns({
        role_col: F.when(kind == 4, "user").otherwise(role),
        text_col: F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text),
        "tessella_kind": kind,
    }).where("tessella_kind > 0")
    return out.withColumn("tessella_again", F.explode(F.when(F.col("tessella_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("tessella_kind", "tessella_again")


def _plus(state: Column, cost: Column | int, letters: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct((state["cost"] + as_column(cost)).alias("cost"), F.concat(state["audit"], as_column(letters)).alias("audit"))


def _with_inserts(states: list[Column]) -> list[Column]:
    """Every place with what insertions from the others give."""
    start, s, u, a = states
    to_u = F.least(u, *[_plus(x, INSERT, "I") for x in (start, s, a)])
    to_a = F.least(a, _plus(u, INSERT, "I"), *[_plus(x, 2 * INSERT, "II") for x in (start, s)])
    return [start, s, to_u, to_a]


def _step(states: Column, turn: Column) -> Column:
    """The four places after one more turn (initial, fault) and insertions behind it."""
    start, s, u, a = (F.get(states, F.lit(i)) for i in range(4))
    initial, gone, extra = turn["initial"], turn["fault"].isin("B", "D"), F.when(turn["fault"] == "T", TRUNCATED).otherwise(0)

    def taken(state: Column, role: str) -> Column:
        """A turn that stays as ``role``; it can't if it is blank or a duplicate."""
        kept = initial == role
        return _plus(state, F.when(gone, NEVER).otherwise(extra + F.when(kept, 0).otherwise(REROLE)), F.when(kept, "K").otherwise("R"))

    first = F.when(initial == "s", 0).otherwise(NEVER)  # s stays as it is, at the start only
    deleted = [_plus(x, DELETE, "D") for x in (start, s, u, a)]
    to_s = F.least(deleted[1], _plus(start, F.when(gone, NEVER).otherwise(extra + first), "K"))
    to_u = F.least(deleted[2], *[taken(x, "u") for x in (start, s, a)])
    to_a = F.least(deleted[3], taken(u, "a"))
    return F.array(*_with_inserts([deleted[0], to_s, to_u, to_a])).cast(_STATES)


def _fold(turns: Column, place: int) -> Column:
    """The four places after ``turns`` from one of them."""
    begin = [F.struct(F.lit(0 if i == place else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for i in range(4)]
    return F.aggregate(turns, F.array(*_with_inserts(begin)).cast(_STATES), _step)


def _joined(states: Column, block: Column) -> Column:
    """The four places after one more block (seg, matrix); a place's path names the block's audit and where it began."""

    def way(i: int, j: int) -> Column:
        state, cell = F.get(states, F.lit(i)), F.get(F.get(block["matrix"], F.lit(i)), F.lit(j))
        piece = F.struct(block["seg"].alias("seg"), F.lit(i).alias("place"), cell["audit"].alias("letters"))
        return F.struct((state["cost"] + cell["cost"]).alias("cost"), F.concat(state["audit"], cell["audit"]).alias("audit"), F.concat(state["path"], F.array(piece)).alias("path")).cast(_PATH)

    return F.array(*[F.least(*[way(i, j) for i in range(4)]) for j in range(4)]).cast(f"array<{_PATH}>")


def _replayed(turns: Column, place: Column, letters: Column) -> Column:
    """``role:text`` of every turn that a block's letters keep, change or insert."""
    begin = F.struct(F.lit(0).alias("row"), place.cast("int").alias("place"), F.array().cast("array<string>").alias("out"))

    def one(state: Column, letter: Column) -> Column:
        turn, role = F.get(turns, state["row"]), F.when(state["place"] == 2, "assistant").otherwise("user")
        initial = F.substring(turn["role"], 1, 1)
        piece = F.when(letter == "K", F.concat(turn["role"], F.lit(":"), turn["text"])).when(letter == "R", F.concat(role, F.lit(":"), turn["text"])).when(letter == "I", F.concat(role, F.lit(":")))
        after = F.when(letter == "D", state["place"]).when(letter == "K", F.when(initial == "s", 1).when(initial == "u", 2).otherwise(3)).when(state["place"] == 2, 3).otherwise(2)
        out = F.concat(state["out"], F.when(letter == "D", F.array().cast("array<string>")).otherwise(F.array(piece)))
        return F.struct((state["row"] + F.when(letter == "I", 0).otherwise(1)).alias("row"), after.alias("place"), out.alias("out"))

    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), begin, one, lambda s: s["out"])


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv, digest) of the sorted pieces (conv, seg, at, piece), newline-joined: a stream of pieces, of which a task holds a batch."""
    schema = f"conv {pieces.schema['conv'].dataType.simpleString()}, digest string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, arrow = None, None, None
        for batch in batches:
            arrow, convs, digests = batch.schema.field("conv").type, [], []
            for conv, piece in zip(batch.column("conv").to_pylist(), batch.column("piece").to_pylist()):
                if digest is None or conv != current:
                    if digest is not None:
                        convs.append(current)
                        digests.append(digest.hexdigest())
                    current, digest = conv, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"\n" + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(digests, pa.string())], ["conv", "digest"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], arrow), pa.array([digest.hexdigest()])], ["conv", "digest"])

    return pieces.repartition("conv").sortWithinPartitions("conv", "seg", "at").mapInArrow(hashed, schema)


def placed_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns dealt and sorted by (conversation, turn, role, text); ``at`` numbers them in this order. Nulls come first; role and text read as one space.

    A conversation's turns may be in many partitions; those that also share turn, role and the text's beginning are in one.
    """
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    named = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role")]
    dealt = named.repartitionByRange(*keys, F.substring("text", 1, 64).asc()).sortWithinPartitions(*keys, F.col("text").asc())
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    marks = {
        "at": F.monotonically_increasing_id(),
        "initial": F.substring("role", 1, 1),
        "blank": ~F.col("text").rlike(f"[^{_WHITE}]"),
        "truncated": ~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"),
        "digest": F.sha2(F.concat(F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("-")), F.lit("\0"), content).cast("binary"), 256),
    }
    return materialise(dealt.withColumns(marks), "turns")


def blocks(placed: DataFrame) -> DataFrame:
    """One row per conversation and block: seg (the first row's number), its faults, edges and the four by four matrix of (cost, audit).

    Duplicates are told by the first row of each content, which is aggregated before the shuffle; the
    adjacent rows' flags by windows over blocks.
    """
    slim = placed.select("conv", "turn", "at", "initial", "blank", "truncated", "digest")
    repeated = materialise(slim.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "repeated")
    flagged = slim.join(repeated, "digest", "left")
    fault = F.when(F.col("blank"), "B").when(F.col("at") > F.col("first"), "D").when(F.col("truncated"), "T").otherwise("")
    block = F.shiftright("at", BLOCK_BITS)
    here = Window.partitionBy("conv", "block").orderBy("at")
    before = F.lag("initial").over(here)
    told = flagged.select("conv", "turn", "at", "initial", fault.alias("fault"), block.alias("block"))
    told = told.withColumns({"illegal": before.isNotNull() & ~F.concat(before, "initial").isin(*LEGAL), "new": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(here))})
    listed = F.sort_array(F.collect_list(F.struct("at", "initial", "fault", "turn")))
    counts = [F.count_if(F.col("fault") == x).alias(n) for x, n in (("B", "blank"), ("D", "duplicate"), ("T", "truncated"))]
    sums = [F.count_if(c).alias(c) for c in ("illegal", "new")]
    grouped = told.groupBy("conv", "block").agg(F.min("at").alias("seg"), listed.alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), *counts, *sums)
    ends = [F.element_at("turns", at)[c].alias(f"{name}_{c}") for at, name in ((1, "first"), (-1, "last")) for c in ("initial", "turn")]
    # turns of a conversation follow each other, so one that doesn't begin with a block begins in it: it has only one place to start from
    begins = F.col("seg").bitwiseAND((1 << BLOCK_BITS) - 1) != 0
    matrix = F.when(begins, F.array_repeat(_fold(F.col("turns"), 0), 4)).otherwise(F.array(*[_fold(F.col("turns"), place) for place in range(4)]))
    return grouped.select("conv", "seg", "low", "high", "blank", "duplicate", "truncated", "illegal", "new", *ends, matrix.alias("matrix"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by number, nulls first, then by role and text. A turn counts as blank, as a duplicate (role
    and text seen earlier) or as truncated, whichever is first. ``gaps`` are numbers missing between the
    smallest and the largest. The edits are those of the least cost, of equals the audit that sorts first.
    A null conversation is one of its own; null roles and texts read as one space; an empty table gives an
    empty result; other columns are not read. Repeated rows are duplicates. The audit of a conversation, a
    byte a turn, has to fit in a row. The digest of a conversation of several blocks is that of a sorted stream of its turns.
    """
    placed = placed_turns(turns, conv_col, turn_col, role_col, text_col)
    told = materialise(blocks(placed), "blocks")
    listed = told.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", *[c for c in told.columns if c not in ("conv", "seg")]))).alias("b"))
    begin = [F.struct(F.lit(0 if i == 0 else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().alias("path")).cast(_PATH) for i in range(4)]
    states = F.aggregate("b", F.array(*begin).cast(f"array<{_PATH}>"), _joined)
    pairs = F.arrays_zip(F.slice("b", 1, F.size("b") - 1).alias("x"), F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))).alias("y"))
    between = F.size(F.filter(pairs, lambda p: ~F.concat(p["x"]["last_initial"], p["y"]["first_initial"]).isin(*LEGAL)))
    shared = F.size(F.filter(pairs, lambda p: p["x"]["last_turn"] == p["y"]["first_turn"]))

    def total(name: str) -> Column:
        return F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x[name])

    span = F.array_max(F.col("b.high")) - F.array_min(F.col("b.low")) + 1 - (total("new") - shared)
    best = F.least(F.get("s", F.lit(0)), F.get("s", F.lit(3)))
    kinds = [total(n).alias(n) for n in ("blank", "duplicate", "truncated")]
    found = listed.select("conv", "b", states.alias("s"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *kinds, (total("illegal") + between).cast("long").alias("illegal"))
    found = materialise(found.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", best.alias("best")), "edits")

    pieces = found.select(F.size("best.path").alias("n"), F.explode("best.path").alias("p")).select("n", "p.*")
    texts = placed.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.min("at").alias("seg"), F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns")).drop("block")
    shown = texts.join(pieces, "seg").select("conv", "seg", "n", _replayed(F.col("turns"), F.col("place"), F.col("letters")).alias("out"))
    whole = F.when(F.col("n") == 1, F.sha2(F.array_join("out", "\n").cast("binary"), 256))
    shown = materialise(shown.select("conv", "seg", whole.alias("digest"), F.when(F.col("n") > 1, F.col("out")).alias("out")), "repaired")
    long = _digests(shown.where("digest IS NULL").select("conv", "seg", F.posexplode("out").alias("at", "piece")))
    digests = shown.where("digest IS NOT NULL").select("conv", "digest").unionByName(long).withColumnRenamed("conv", "of")
    out = found.join(digests, F.col("conv").eqNullSafe(F.col("of")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.coalesce("digest", nothing).alias("repaired_sha256"))


def with_all(found: DataFrame, turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``found`` with a row of zeros, no audit and the digest of nothing for each conversation of ``turns`` that it lacks."""
    every = turns.select(F.col(f"`{conv_col}`").alias("every")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.join(found, F.col("every").eqNullSafe(F.col("conv")), "left")
    return joined.select(F.col("every").alias("conv"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
