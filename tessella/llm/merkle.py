"""Merkle manifest of a dataset: a forest of hash trees, one for each source, under a tree of their roots.

Any set of nodes, keyed by (tree, level, index), is a sparse forest; two are merged by putting their nodes
together and replacing every complete run of siblings by its parent. The widths of all levels follow from
a tree's number of leaves, so a run is known to be complete. Merging is associative and commutative: each
part of the sorted leaves folds its own, and ``treeReduce`` merges what they leave over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Children of a node; leaves that a part of the sorted table holds; parts whose left-over nodes one task merges.
ARITY, PART_ROWS, FAN = 3, 100_000, 128
#: The number of the tree whose leaves are the roots of all others.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Node = tuple[int, int, int]


def joined_hash(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Shape:
    """Numbers of leaves by tree: what is a run's size, and where does a tree end."""

    def __init__(self, leaves: dict[int, int]):
        self.widths = {}
        for tree, n in leaves.items():
            widths = [n]
            while widths[-1] > 1:
                widths.append(-(-widths[-1] // ARITY))
            self.widths[tree] = widths

    def run(self, node: Node) -> list[Node]:
        """A node and its siblings, left to right."""
        tree, level, index = node
        first = index - index % ARITY
        return [(tree, level, i) for i in range(first, min(first + ARITY, self.widths[tree][level]))]

    def parent(self, node: Node) -> Node | None:
        """A tree's root becomes a leaf of the top tree, whose root has no parent."""
        tree, level, index = node
        if level < len(self.widths[tree]) - 1:
            return tree, level + 1, index // ARITY
        return None if tree == TOP else (TOP, 0, tree)

    def is_root(self, node: Node) -> bool:
        return node[1] == len(self.widths[node[0]]) - 1


def merge(forest: dict[Node, str], more: dict[Node, str], shape: Shape, made: dict[Node, str] | None = None) -> dict[Node, str]:
    """``forest`` with the nodes of ``more``, resolved; ``made`` gets the nodes that came about."""
    for node, digest in more.items():
        while True:
            forest[node] = digest
            up = shape.parent(node)
            if up is None:
                break
            if shape.is_root(node):
                del forest[node]
            else:
                run = shape.run(node)
                if not all(n in forest for n in run):
                    break
                digest = joined_hash([forest.pop(n) for n in run])
            node = up
            if made is not None:
                made[node] = digest
    return forest


def siblings_of(node: Node, shape: Shape) -> Iterator[tuple[Node, list[Node]]]:
    """(node, its siblings) from a node up to the last one with a parent."""
    while (up := shape.parent(node)) is not None:
        if not shape.is_root(node):
            yield node, [n for n in shape.run(node) if n != node]
        node = up


def leaf_hash(fields: dict[str, Column]) -> Column:
    """sha256 of all fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def sorted_leaves(docs: DataFrame, tampered: Column, tampered_text: Column, id_col: str, group_col: str, text_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id as text, grp, leaf, tampered, at, part), dealt by ranges of (grp, id, leaf); ``at`` numbers the rows in this order.

    Texts are hashed where they are read. Rows of one source, of one id or of equal content are split as
    well, as their number in the stored table is the last key.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    changed = F.when(tampered, leaf_hash(columns | {text_col: tampered_text}))
    hashed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("grp"), leaf_hash(columns).alias("leaf"), changed.alias("tampered"))
    hashed = materialise(hashed, "leaves").withColumn("row", F.monotonically_increasing_id())
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-hashed.count() // PART_ROWS))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()]
    dealt = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = dealt.select(F.col("id").cast("string").alias("id"), "grp", "leaf", "tampered", F.monotonically_increasing_id().alias("at"))
    return materialise(numbered.withColumn("part", F.shiftright("at", 33)), "sorted-leaves")


def _edges(leaves: DataFrame) -> tuple[dict[int, tuple[int, int, dict[int, int]]], int]:
    """({part: (its first tree, leaves of that in earlier parts, leaves of its first and last tree)}, number of trees).

    Sources are named by digests here, and a part tells of its first and last one only: what the driver
    holds grows with the parts, not with rows or sources.
    """
    name = F.coalesce(F.sha2(F.col("grp").cast("binary"), 256), F.lit(""))
    by_source = leaves.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    said = F.struct(name.alias("name"), "n")
    rows = by_source.groupBy("part").agg(F.count("*").alias("sources"), F.min_by(said, "at").alias("low"), F.max_by(said, "at").alias("high")).collect()
    found, totals, tree, current, before = {}, {}, -1, None, 0
    for r in sorted(rows, key=lambda r: r.part):
        if r.low.name != current:
            tree, before = tree + 1, 0
        first, offset = tree, before
        totals[tree] = before = before + r.low.n
        if r.sources > 1:
            tree += r.sources - 1
            totals[tree] = before = r.high.n
        current = r.high.name
        found[r.part] = first, offset, tree
    return {p: (first, offset, {t: totals[t] for t in (first, last)}) for p, (first, offset, last) in found.items()}, tree + 1


def _numbered(rows: pd.DataFrame, edge: tuple) -> tuple[pd.DataFrame, list[int], list[int], dict[int, int]]:
    """A part's rows in order, the tree and index of each, and the leaves of its trees."""
    first, offset, sizes = edge
    rows = rows.sort_values("at")
    trees, indexes, tree, index, last, own = [], [], first - 1, 0, None, dict(sizes)
    for name in rows.grp.where(rows.grp.notna(), None).tolist():
        name = (name,)  # None is a source too
        if name != last:
            tree, index, last = tree + 1, offset if tree < first else 0, name
        trees.append(tree)
        indexes.append(index)
        index += 1
        if tree not in sizes:
            own[tree] = index
    return rows, trees, indexes, own


NODES = "part long, tree long, level long, index long, digest string"


def _as_frame(part: int, nodes: dict[Node, str | None]) -> pd.DataFrame:
    listed = list(nodes.items())
    columns = {k: [n[i] for n, _ in listed] for i, k in enumerate(("tree", "level", "index"))}
    return pd.DataFrame({"part": [part] * len(listed), **columns, "digest": [d for _, d in listed]})


def _as_nodes(rows: pd.DataFrame) -> dict[Node, str]:
    return dict(zip(zip(rows.tree.tolist(), rows.level.tolist(), rows["index"].tolist()), rows.digest.tolist()))


def _folded(rows: pd.DataFrame, edges: dict, trees: int, made: dict[Node, str] | None = None):
    """(a part's rows, tree and index of each, shape, forest) with all leaves merged."""
    rows, tree, index, sizes = _numbered(rows, edges[int(rows.part.iloc[0])])
    shape = Shape(sizes | {TOP: trees})
    leaves = dict(zip(((t, 0, i) for t, i in zip(tree, index)), rows.leaf.tolist()))
    if made is not None:
        made |= leaves
    return rows, tree, index, shape, merge({}, leaves, shape, made)


def proofs(docs: DataFrame, tampered: Column, tampered_text: Column, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` marks rows whose ``text_col`` has become ``tampered_text``; these fold that leaf with the
    original siblings. A source's leaves ascend by id, nulls first, then by leaf. Rows that repeat id and
    leaf stay repeated. A null in any field is ``-``; a null source is a source, before all others. An empty table gives an empty result. Other
    columns are not read. Ids are compared as their type does. The digests of a part are in one task,
    nodes that parts leave over (some dozens each) in stored tables, the root on the driver.
    """
    spark = docs.sparkSession
    leaves = sorted_leaves(docs, tampered, tampered_text, id_col, group_col, text_col, fields)
    edges, trees = _edges(leaves)
    kind = docs.schema[id_col].dataType.simpleString()
    result = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not trees:
        return spark.createDataFrame([], result).withColumn("id", F.col("id").cast(kind))
    sizes = {t: n for _, _, known in edges.values() for t, n in known.items()}
    shape, at_edges = spark.sparkContext.broadcast(Shape(sizes | {TOP: trees})), spark.sparkContext.broadcast(edges)

    def left_over(rows: pd.DataFrame) -> pd.DataFrame:
        """A part's unresolved nodes with their digests, and without one the nodes that its proofs lack."""
        made: dict[Node, str] = {}
        *_, own, forest = _folded(rows, at_edges.value, trees, made)
        part = int(rows.part.iloc[0])
        lacks = {n for node in forest for _, others in siblings_of(node, own) for n in others if n not in made}
        ends = {(t, len(own.widths[t]) - 1, 0) for t in (at_edges.value[part][0], max(own.widths))}  # subroots of sources that go on elsewhere
        return _as_frame(part, forest | dict.fromkeys(lacks | {n for n in ends if n not in made}))

    over = materialise(leaves.groupBy("part").applyInPandas(left_over, NODES), "left-over")
    known = over.where("digest IS NOT NULL")

    def fragment(rows: Iterator) -> Iterator[dict[Node, str]]:
        yield merge({}, {(r.tree, r.level, r["index"]): r.digest for r in rows}, shape.value)

    ((_, root),) = known.rdd.mapPartitions(fragment).treeReduce(lambda a, b: merge(a, b, shape.value)).items()

    # the nodes that come about between parts, by rounds of the same merge, stored for the proofs
    def one_round(rows: pd.DataFrame) -> pd.DataFrame:
        made: dict[Node, str] = {}
        forest, part = merge({}, _as_nodes(rows), shape.value, made), int(rows["group"].iloc[0])
        rest = _as_frame(part, {n: d for n, d in made.items() if n not in forest}).assign(kept=False)
        return pd.concat([rest, _as_frame(part, forest).assign(kept=True)])

    between, rest, parts = [known.select("tree", "level", "index", "digest")], known, max(edges) + 1
    while True:
        merged = materialise(rest.withColumn("group", F.floor(F.col("part") / FAN).cast("long")).groupBy("group").applyInPandas(one_round, NODES + ", kept boolean"), "merged")
        between.append(merged.select("tree", "level", "index", "digest"))
        rest, parts = merged.where("kept").drop("kept"), -(-parts // FAN)
        if parts == 1:
            break
    nodes = between[0]
    for more in between[1:]:
        nodes = nodes.unionByName(more)
    wanted = over.where("digest IS NULL").drop("digest")
    paths = materialise(wanted.join(nodes.distinct(), ["tree", "level", "index"]), "paths")

    def folded(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        made = _as_nodes(path)
        rows, tree, index, own, _ = _folded(rows, at_edges.value, trees, made)
        out: dict[str, list] = {c: [] for c in ("subroot", "proof_sha256", "folded_root")}
        for t, i, leaf in zip(tree, index, rows.tampered.where(rows.tampered.notna(), rows.leaf)):
            proof, digest = [], leaf
            for (_, _, at), others in siblings_of((t, 0, i), own):
                found = [made[n] for n in others]
                proof += found
                place = at % ARITY
                digest = joined_hash([*found[:place], digest, *found[place:]])
            out["subroot"].append(made[t, len(own.widths[t]) - 1, 0])
            out["proof_sha256"].append(joined_hash(proof))
            out["folded_root"].append(digest)
        told = pd.DataFrame({"id": rows.id.tolist(), "leaf": rows.leaf.tolist(), **out, "root": root})
        told["verified"] = told.folded_root == root
        return told[["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    out = leaves.groupBy("part").cogroup(paths.groupBy("part")).applyInPandas(folded, result)
    return out.withColumn("id", F.col("id").cast(kind))
