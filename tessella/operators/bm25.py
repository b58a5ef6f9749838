"""BM25 per domain: posting blocks with bounds of each term, searched block by block.

A block has the postings of a few chunks of one domain and similar length. For each of its terms
it stores the largest count and the smallest length, which bound the term's part of any score in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.text import tokens
from ..storage import stored, stored_in_pieces
from .blocks import BUFFER, HELD_FILES, NARROW, ROWS, Best, as_batch, buffered, codes, count_batch, listed, query_blocks, read_block, whole


#: Tokens whose postings are made at once, which takes several times their memory; a block isn't cut for it.
TOKENS = 1 << 16


@dataclass(frozen=True)
class Bm25Index:
    """``blocks``: postings (see ``posting_blocks``). ``terms``: domain, term, df, idf. ``domains``: domain, n, avgdl."""

    blocks: DataFrame
    terms: DataFrame
    domains: DataFrame


def _postings(ids: pa.Array, domain: pa.Array, t: pa.Array, starts: np.ndarray) -> pa.RecordBatch:
    """The blocks that begin at ``starts``, of chunks in their order."""
    row_ends, size, words = np.append(starts[1:], len(ids)), np.diff(t.offsets.to_numpy()), t.flatten().dictionary_encode()
    names, n_names = words.dictionary, max(1, len(words.dictionary))
    block, row = np.repeat(np.arange(len(starts)), np.diff(row_ends, prepend=0)), np.repeat(np.arange(len(size)), size)
    cells = (block[row] * n_names + words.indices.to_numpy()) * ROWS + row - starts[block[row]] if len(row) else np.empty(0, np.int64)
    cells, counts = np.unique(cells, return_counts=True)  # by block, term, place
    key, doc = np.divmod(cells, ROWS)
    edges = np.flatnonzero(np.diff(key, prepend=-1))
    of_term, of_block = key[edges] % n_names, key[edges] // n_names
    long = size[starts[key // n_names] + doc]
    most, least = (np.maximum.reduceat(counts, edges), np.minimum.reduceat(long, edges)) if len(edges) else (counts, long)
    to = np.append(edges[1:], len(cells))
    term_ends = np.searchsorted(of_block, np.arange(len(starts)), side="right")
    cell_ends = np.concatenate(([0], to))[term_ends]
    base = np.concatenate(([0], cell_ends))[of_block]
    narrow = lambda x: x.astype(np.int32)
    columns = [domain.take(pa.array(starts)), listed(ids, row_ends), listed(narrow(size), row_ends), listed(names.take(pa.array(of_term)), term_ends)]
    columns += [listed(narrow(to - base), term_ends), listed(narrow(doc), cell_ends), listed(narrow(counts), cell_ends), listed(narrow(most), term_ends), listed(narrow(least), term_ends)]
    return pa.RecordBatch.from_arrays(columns, ["domain", "chunk_ids", "lengths", "terms", "ends", "docs", "counts", "most", "least"])


def posting_blocks(chunks: DataFrame) -> DataFrame:
    """One row per block of chunks (chunk_id, domain, t), cut where they are read, without a shuffle.

    ``terms``, ``most`` (largest count), ``least`` (smallest length) and ``ends`` go by term; postings ``docs``
    (places in ``chunk_ids`` and ``lengths``) and ``counts`` of term i stand before ``ends[i]``.
    """
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    fields = "lengths array<int>, terms array<string>, ends array<int>, docs array<int>, counts array<int>, most array<int>, least array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in buffered(batches, BUFFER):
            ids, domain, t = (whole(table.column(c)) for c in range(3))
            lengths = np.diff(t.offsets.to_numpy())
            order = np.lexsort((lengths, group := codes(domain)))
            first = np.concatenate(([True], np.diff(group[order]) != 0))
            within = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            starts = np.flatnonzero(first | (within % ROWS == 0))
            share = np.cumsum(lengths[order], dtype=np.int64)[starts] // TOKENS
            for blocks in np.split(starts, np.flatnonzero(np.diff(share)) + 1):
                to = starts[np.searchsorted(starts, blocks[-1], side="right") :][:1]
                rows = pa.array(order[blocks[0] : to[0] if len(to) else len(order)])
                yield _postings(ids.take(rows), domain.take(rows), t.take(rows), blocks - blocks[0])

    return chunks.select("chunk_id", "domain", "t").mapInArrow(cut, f"domain string, chunk_ids array<{id_type}>, {fields}")


def build_index(chunks: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> Bm25Index:
    """Index ``chunks`` (chunk_id of any type, domain, content); statistics never cross domains.

    Texts are tokenized once. A negative idf becomes ``epsilon`` times the mean idf of the domain's
    vocabulary. Empty texts count as chunks. Null domains are none of the domains. An empty table gives an empty index.
    """
    told = chunks.where("domain IS NOT NULL").select("chunk_id", "domain", tokens(F.col("content")).alias("t"))
    blocks = stored_in_pieces(posting_blocks(told), "posting-blocks", **NARROW)
    words = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    domains = stored(blocks.groupBy("domain").agg(F.sum(F.size("lengths")).alias("n"), (F.sum(words) / F.sum(F.size("lengths"))).alias("avgdl")), "domains")
    df = F.transform("terms", lambda term, i: F.struct(term.alias("term"), (F.get("ends", i) - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("df")))
    counted = blocks.select("domain", F.explode(df).alias("x")).groupBy("domain", "x.term").agg(F.sum("x.df").alias("df")).join(domains, "domain")
    plain = counted.withColumn("plain", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    plain = stored(plain.select("domain", "term", "df", "plain"), "terms")
    means = plain.groupBy("domain").agg(F.avg("plain").alias("mean"))
    idf = F.when(F.col("plain") < 0, config.epsilon * F.col("mean")).otherwise(F.col("plain"))
    return Bm25Index(blocks, plain.join(means, "domain").select("domain", "term", "df", idf.alias("idf")), domains)


@dataclass(frozen=True)
class _Block:
    """Queries of a file: their terms, and of each domain avgdl, where each term's queries begin, and these with weights."""

    ids: pa.Array
    terms: pa.Array
    domains: dict[str, tuple[float, np.ndarray, np.ndarray, np.ndarray]]


@lru_cache(maxsize=2)
def _block(uri: str) -> _Block:
    rows = read_block(uri)
    terms, ids = pc.unique(whole(rows["term"])), pc.unique(whole(rows["query_id"]))
    query = pc.index_in(whole(rows["query_id"]), value_set=ids).to_numpy()
    code, weight = pc.index_in(whole(rows["term"]), value_set=terms).to_numpy(), rows["weight"].to_numpy()
    domain, found = np.array(rows["domain"].to_pylist(), object), {}
    for name in dict.fromkeys(domain.tolist()):
        here = np.flatnonzero(domain == name)
        here = here[np.argsort(code[here], kind="stable")]
        starts = np.concatenate(([0], np.cumsum(np.bincount(code[here], minlength=len(terms)))))
        found[name] = float(rows["avgdl"][int(here[0])].as_py()), starts, query[here], weight[here]
    return _Block(ids, terms, found)


def _searched(index: Bm25Index, queries: DataFrame, config: RetrievalConfig, schema: str, counting: bool) -> DataFrame:
    wanted = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighed = wanted.join(index.terms, "term").join(index.domains.select("domain", "avgdl"), "domain")
    files = query_blocks(weighed.select("query_id", "domain", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"), "query-terms")
    k, k1, b = config.per_source, config.k1, config.b

    def part(count: np.ndarray, length: np.ndarray, avgdl: float) -> np.ndarray:
        return count * (k1 + 1) / (count + k1 * (1 - b + b * length / avgdl))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, Best]] = {}
        for table in buffered(batches, BUFFER // ROWS):
            domain = table.column(0).to_pylist()
            ids, lengths, terms, ends, docs, counts, most, least = (whole(table.column(c)) for c in range(1, 9))
            for file in files:
                asked, held, scored, pairs = _block(file), kept.setdefault(file, {}) if len(files) <= HELD_FILES else {}, 0, 0
                at = pc.index_in(terms.flatten(), value_set=asked.terms).fill_null(-1).to_numpy()
                for i, name in enumerate(domain):
                    if name not in asked.domains:
                        continue
                    avgdl, starts, query, weight = asked.domains[name]
                    top = held.setdefault(name, Best(len(asked.ids), k))
                    span = slice(terms.offsets[i].as_py(), terms.offsets[i + 1].as_py())
                    known = np.flatnonzero(at[span] >= 0)
                    code, size = at[span][known], lengths[i].values.to_numpy()
                    each = starts[code + 1] - starts[code]
                    hit = np.repeat(starts[code] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    bound = part(most[i].values.to_numpy()[known], least[i].values.to_numpy()[known], avgdl)
                    limit = np.bincount(query[hit], np.maximum(weight[hit], 0) * np.repeat(bound, each), len(asked.ids))
                    active = np.flatnonzero((limit > 0) & (limit >= top.floor()))
                    pairs += len(asked.ids) * len(size)
                    if not len(active):
                        continue
                    scored += len(active) * len(size)
                    column = np.full(len(asked.ids), -1)
                    column[active] = np.arange(len(active))
                    mine = column[query[hit]] >= 0
                    weights = np.zeros((len(code), len(active)))
                    weights[np.repeat(np.arange(len(code)), each)[mine], column[query[hit[mine]]]] = weight[hit[mine]]
                    to = ends[i].values.to_numpy()
                    before = np.concatenate(([0], to[:-1]))
                    n = (to - before)[known]
                    cell = np.repeat(before[known] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    doc = docs[i].values.to_numpy()[cell]
                    parts = np.zeros((len(size), len(code)))
                    parts[doc, np.repeat(np.arange(len(code)), n)] = part(counts[i].values.to_numpy()[cell], size[doc], avgdl)
                    scores = parts @ weights
                    top.add(active, np.where(scores > 0, scores, -np.inf), ids[i].values)
                if counting:
                    yield count_batch(scored, pairs)
                elif file in kept:
                    for top in held.values():
                        top.settle()
                else:
                    yield from (as_batch(asked.ids, name, rows) for name, top in held.items() if (rows := top.rows()))
        if not counting:
            for file, held in kept.items():
                yield from (as_batch(_block(file).ids, name, rows) for name, top in held.items() if (rows := top.rows()))

    return index.blocks.mapInArrow(best, schema)


def search(index: Bm25Index, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, domain, chunk_id, score, rank): the best chunks of each query (query_id, question) and domain.

    Only chunks that share a term with a query are found, and of these only those with a score above
    0. A term that a query has twice counts twice. Ties go by chunk_id. Ids are of any type; a null
    question finds nothing.
    """
    types = [index.blocks.schema["chunk_ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    found = _searched(index, queries, config, f"query_id {types[1]}, domain string, chunk_id {types[0]}, score double", False)
    return top_k(stored_in_pieces(found, "sparse-found"), config.per_source)


def scored_pairs(index: Bm25Index, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> tuple[int, int]:
    """(pairs of query and chunk that a search scores, all pairs of a query and a chunk of its domains)."""
    row = _searched(index, queries, config, "scored long, pairs long", True).agg(F.sum("scored"), F.sum("pairs")).first()
    return row[0] or 0, row[1] or 0


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query and domain with their rank from 1; ties by chunk_id."""
    order = Window.partitionBy("query_id", "domain").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
