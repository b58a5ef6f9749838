"""Toxicity scores by the votes of the nearest labelled examples.

Texts are vectors of TF-IDF weights over all their words and word beginnings; document frequencies
are those of all documents. The nearest of a bounded sample of labelled examples by exact cosine are
found in a block-max index over every term of the examples, their distance-weighted votes are
calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .pieces import slices

#: Default bound of the fit: labelled examples (a sample by hash of the id, toxic ones first, up to half).
MOST_EXAMPLES = 4000
#: Beginnings of words of so many letters are terms, too.
BEGINNINGS = (4, 5, 6, 7)
#: Terms in more than this share of the documents are known to every task, as are those of the examples.
COMMON_SHARE = 1 / 1000
NEIGHBOURS, EVIDENCE = 300, 5
#: Examples of a block; terms in this share of the examples have dense rows of weights instead of postings.
BLOCK, DENSE_SHARE = 512, 1 / 12
#: Texts and their bytes that are counted at once, and texts and postings that a search holds at once.
_ROWS, _BYTES, _TEXTS, _POSTINGS = 768, 1 << 21, 128, 1 << 16
#: A share of toxic examples and its weight in examples, for when there are few or none.
PRIOR_SHARE, PRIOR_WEIGHT = 0.1, 5.0


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, rows, which, counts) of texts without nulls: text ``rows[i]`` has ``terms[which[i]]`` ``counts[i]`` times.

    Terms are words, that is runs of letters in lower case, and beginnings of longer ones with a star behind.
    """
    listed = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "), " ")
    words, offsets = listed.flatten().dictionary_encode(), listed.offsets.to_numpy()
    letters = pc.utf8_length(words.dictionary).to_numpy()
    of_word, terms, width = [np.where(letters > 0, np.arange(len(letters)), -1)], [words.dictionary], len(letters)
    for k in BEGINNINGS:
        long = letters > k
        cut = pc.utf8_slice_codeunits(words.dictionary.filter(pa.array(long)), 0, k).dictionary_encode()
        place = np.full(len(letters), -1)
        place[long] = width + cut.indices.to_numpy()
        of_word.append(place)
        terms.append(pc.binary_join_element_wise(cut.dictionary, "*", ""))
        width += len(cut.dictionary)
    which = np.stack(of_word, axis=1)[words.indices.to_numpy()]
    keys = np.repeat(np.arange(len(texts)) * max(1, width), np.diff(offsets))[:, None] + which
    cells, counts = np.unique(keys[which >= 0], return_counts=True)
    rows, which = np.divmod(cells, max(1, width))
    return pa.concat_arrays(terms), rows, which, counts


@dataclass(frozen=True)
class Counted:
    """Texts as counts of a vocabulary's terms: ``numbers`` of text k, ascending, and ``counts`` from
    ``starts[k]`` to ``starts[k + 1]``; ``others`` lists the terms without a number with their counts."""

    starts: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    others: pa.ListArray

    @classmethod
    def of(cls, texts: pa.Array, vocabulary: pa.Array) -> Counted:
        terms, rows, which, counts = terms_of(texts)
        numbers = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)[which]
        known, each = numbers >= 0, np.arange(len(texts) + 1)
        order = np.argsort(rows[known] * max(1, len(vocabulary)) + numbers[known])
        rest = pa.StructArray.from_arrays([terms.take(pa.array(which[~known])), pa.array(counts[~known].astype(np.int32))], ["term", "count"])
        others = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[~known], each).astype(np.int32)), rest)
        return cls(np.searchsorted(rows[known], each), numbers[known][order], counts[known][order], others)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in zip(self.starts.tolist(), self.starts[1:].tolist()):
            yield self.numbers[a:b], self.counts[a:b]


class BlockMaxIndex:
    """Exact nearest examples by cosine, blocks of examples at a time.

    ``examples`` are (ids, labels, term numbers, counts). Terms of few examples have sparse postings,
    those of many a dense row of weights, and for every one of these the largest weight in each block
    is kept. A query adds the postings up; the sums so far, from which comes a floor of the last
    neighbour's cosine, and the largest weights bound the cosines of a block. Blocks whose bound
    is below the floor are left out, of the others the dense rows are added. Ties go to the smaller id.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray):
        self.idf = idf
        vectors = [self.weights(t, c) for t, c in zip(terms, counts)]
        # like stands by like: by the commonest terms of each, which tell its language
        order = sorted(range(len(ids)), key=lambda k: (*terms[k][np.argsort(idf[terms[k]], kind="stable")[:8]].tolist(), int(ids[k])))
        self.ids, self.labels = ids[order].astype(np.int64), labels[order].astype(np.float64)
        self.blocks = -(-len(order) // BLOCK)
        rows = np.repeat(np.arange(len(order), dtype=np.int32), [len(terms[k]) for k in order])
        numbers = np.concatenate([np.zeros(0, np.int32), *(terms[k] for k in order)])
        weights = np.concatenate([np.zeros(0), *(vectors[k] for k in order)])
        dense = np.flatnonzero(np.bincount(numbers, minlength=len(idf)) > max(1, len(order) * DENSE_SHARE))
        self.dense_at = np.full(len(idf), -1, np.int64)
        self.dense_at[dense] = np.arange(len(dense))
        at = self.dense_at[numbers]
        self.dense = np.zeros((len(dense), self.blocks * BLOCK))
        self.dense[at[at >= 0], rows[at >= 0]] = weights[at >= 0]
        self.largest = self.dense.reshape(len(dense), self.blocks, BLOCK).max(axis=2) if len(order) else np.zeros((len(dense), 0))
        rows, numbers, weights = rows[at < 0], numbers[at < 0], weights[at < 0]
        by_term = np.argsort(numbers, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(numbers, minlength=len(idf)))))
        self.rows, self.postings = rows[by_term], weights[by_term]

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The unit vector of a text over its terms; zeros stay zeros."""
        w = self.raw_weights(terms, counts)
        size = np.sqrt((w * w).sum())
        return w / size if size else w

    def raw_weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(np.maximum(counts, 1.0, dtype=np.float64))) * self.idf[terms]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the up to ``k`` nearest examples that share a term; ``without`` leaves a row out."""
        return next(self.search([(terms, weights)], k, None if without is None else [without]))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every query, in order."""
        for at in range(0, len(queries), _TEXTS):
            yield from self._search(queries[at : at + _TEXTS], k, without and without[at : at + _TEXTS])

    def _sums(self, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the postings give every example, by query; as many queries at once as have _POSTINGS of them."""
        m, width = len(ends) - 1, self.blocks * BLOCK
        sums, sizes = np.zeros((m, width)), self.starts[terms + 1] - self.starts[terms]
        total = np.concatenate(([0], np.cumsum(sizes)))[ends]
        a = 0
        while a < m:
            b = max(a + 1, int(np.searchsorted(total, total[a] + _POSTINGS, side="right")) - 1)
            part, n = slice(ends[a], ends[b]), sizes[ends[a] : ends[b]]
            at = np.repeat(self.starts[terms[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(np.arange(b - a) * width, np.diff(total[a : b + 1]))
            if len(at):
                sums[a:b] = np.bincount(row + self.rows[at], self.postings[at] * np.repeat(weights[part], n), (b - a) * width).reshape(b - a, width)
            a = b
        return sums

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, width = len(queries), self.blocks * BLOCK
        lengths = [len(t) for t, _ in queries]
        query, ends = np.repeat(np.arange(m), lengths), np.concatenate(([0], np.cumsum(lengths)))
        terms, weights = (np.concatenate(x) for x in zip(*queries))
        sums = self._sums(terms, weights, ends)
        known = self.dense_at[terms] >= 0
        heavy = np.zeros((m, len(self.dense)))
        heavy[query[known], self.dense_at[terms[known]]] = weights[known]
        bound = sums.reshape(m, self.blocks, BLOCK).max(axis=2, initial=0) + heavy @ self.largest
        spare = k + (without is not None)  # the row that is left out may be among the sums
        floor = np.partition(sums, width - spare, axis=1)[:, width - spare] if width > spare else np.zeros(m)
        for block in range(self.blocks):
            some = np.flatnonzero(bound[:, block] >= floor - 1e-5)
            here = slice(block * BLOCK, (block + 1) * BLOCK)
            if len(some) == m:
                sums[:, here] += heavy @ self.dense[:, here]
            elif len(some):
                sums[some, here] += heavy[some] @ self.dense[:, here]
        if without is not None:
            sums[np.arange(m), without] = 0
        least = np.partition(sums, width - k, axis=1)[:, width - k] if width > k else np.zeros(m)
        for found, last in zip(sums, least.tolist()):
            rows = np.flatnonzero(found > max(1e-7, last - 2e-6))
            cosines = np.round(found[rows], 6)
            best = np.lexsort((self.ids[rows], -cosines))[:k]
            yield rows[best], np.minimum(found[rows[best]], 1.0)


@dataclass
class ToxicityModel:
    """Examples in the order of their texts' hashes, as counts of terms, one example behind another.

    The index is made where it is asked for, and not sent along.
    """

    terms: pa.Array
    idf: np.ndarray
    names: list
    labels: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    share: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    @cached_property
    def index(self) -> BlockMaxIndex:
        cuts = self.starts[1:-1]
        return BlockMaxIndex(np.arange(len(self.names)), self.labels, np.split(self.numbers, cuts), np.split(self.counts, cuts), self.idf)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """The share of toxic votes, which fall with the squared distance from the nearest's cosine
        to none; one more vote has the share of all examples."""
        if not len(rows):
            return self.share
        weight = (np.round(cosines, 6) / max(round(float(cosines[0]), 6), 1e-6)) ** 2
        return float((weight @ self.index.labels[rows] + self.share) / (weight.sum() + 1))


def calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic regression of the labels on the examples' votes."""
    x = np.column_stack((np.log(votes / (1 - votes)), np.ones(len(votes))))
    theta, keep = np.array([1.0, 0.0]), np.array([0.01, 0.01])
    for _ in range(60):  # Newton's method, held near slope 1 and shift 0
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - keep * (theta - [1.0, 0.0])
        theta = theta + np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + np.diag(keep), gradient)
    return max(float(theta[0]), 0.1), float(theta[1])


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of the labelled ids whose crc32 leaves 1 to 4 modulo 5.

    An id with several labels is toxic if any is 1; rows without id or label are left out.
    """
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col).cast("int") == 1).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    return known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))


def example_sample(labels: DataFrame, id_col: str, label_col: str, most: int = MOST_EXAMPLES) -> DataFrame:
    """(id, toxic) of up to ``most`` of the labelled ids, by hash of the id.

    Toxic ones take up to half of the places, and those that the others leave.
    """
    known = labelled(labels, id_col, label_col)
    toxic, clean = sizes_of(known)
    places = min(toxic, max(most // 2, most - clean))
    of = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(n)
    return of(1, places).unionByName(of(0, most - places))


def sizes_of(known: DataFrame) -> tuple[int, int]:
    """Toxic and other rows."""
    total = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    return total[0], total[1] - total[0]


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, n) of every term in the column ``text``; rows are added up by batch and by task before the shuffle."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 0, _ROWS, _BYTES)):
            terms, _, which, _ = terms_of(batch.column(0))
            found = np.bincount(which, minlength=len(terms))
            yield pa.RecordBatch.from_arrays([terms, pa.array(found.astype(np.int64))], ["term", "n"]).filter(pa.array(found > 0))

    return texts.select("text").mapInArrow(listed, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class Fit:
    """What ``fit`` finds: the shared model (None if only one kind of label is known), the calibration,
    the document frequencies of all terms, and the number of documents."""

    model: Broadcast | None
    share: float
    slope: float
    shift: float
    frequencies: DataFrame | None
    number: int

    def score(self, vote: Column) -> Column:
        odds = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), self.slope * F.log(vote / (1 - vote)) + self.shift))
        return 1 / (1 + F.exp(-odds))


def example_vectors(examples: DataFrame, terms: pa.Array) -> DataFrame:
    """(digest, id, toxic, numbers, counts) of the examples (id, text, digest, toxic)."""
    shared = examples.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 3, _ROWS, _BYTES)):
            found = Counted.of(batch.column(3), shared.value)
            lists = [pa.ListArray.from_arrays(pa.array(found.starts.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (found.numbers, found.counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["digest", "id", "toxic", "numbers", "counts"])

    types = dict(examples.dtypes)
    return examples.select("digest", "id", "toxic", "text").mapInArrow(counted, f"digest long, id {types['id']}, toxic {types['toxic']}, numbers array<int>, counts array<int>")


def example_votes(examples: DataFrame, shared: Broadcast, neighbours: int) -> DataFrame:
    """(toxic, vote) of every example, by the votes of all others."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = model.index
        place = dict(zip(model.names, np.argsort(index.ids).tolist()))
        for batch in (part for b in batches for part in slices(b, 2, _ROWS, _BYTES)):
            near = index.search([(t, index.weights(t, c)) for t, c in Counted.of(batch.column(2), model.terms)], neighbours, [place[i] for i in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([model.vote(*found) for found in near], pa.float64())], ["toxic", "vote"])

    return examples.select("id", "toxic", "text").mapInArrow(voted, f"toxic {dict(examples.dtypes)['toxic']}, vote double")


def fit(texts: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = MOST_EXAMPLES, neighbours: int = NEIGHBOURS) -> Fit:
    """Fit the model to ``texts`` (id, text) and labels.

    What comes to the driver is bounded by the examples and COMMON_SHARE: the terms of ``most``
    examples and the common ones, with their document frequencies, and the examples' counts. Of
    the rows that repeat an example's id the text with the smallest hash is the example. Labels weigh in
    the calibration as often as all labels say, whatever the sample's shares.
    """
    context = texts.sparkSession.sparkContext
    sample = materialise(example_sample(labels, id_col, label_col, most), "example-ids")
    digest = F.xxhash64("text")
    examples = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min_by("text", F.struct(digest, "text")).alias("text"))
    examples = materialise(examples.withColumn("digest", digest).repartition(context.defaultParallelism, "id"), "examples")
    number = texts.count()
    toxic, clean = sizes_of(examples)
    share = (toxic + PRIOR_SHARE * PRIOR_WEIGHT) / (toxic + clean + PRIOR_WEIGHT)
    if not toxic or not clean:
        return Fit(None, float(share), 1.0, 0.0, None, number)
    frequencies = materialise(document_frequencies(texts), "document-frequencies")
    own = document_frequencies(examples).select("term", F.lit(True).alias("own"))
    listed = frequencies.join(own, "term", "left").where(F.col("own") | (F.col("n") > number * COMMON_SHARE)).select("term", "n").orderBy("term").toArrow()
    terms, idf = pa.concat_arrays(listed.column(0).chunks), np.log((1 + number) / (1 + listed.column(1).to_numpy()))
    found = example_vectors(examples, terms).orderBy("digest", "id").toArrow().combine_chunks()
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (found["numbers"], found["counts"])]
    starts = flat[0].offsets.to_numpy().astype(np.int64)
    numbers, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in flat)
    counts = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32)
    model = ToxicityModel(terms, idf, found["id"].to_pylist(), found["toxic"].to_numpy(), starts - starts[0], numbers, counts, float(share))
    shared = context.broadcast(model)
    votes = example_votes(examples, shared, neighbours).toArrow()
    kinds = votes["toxic"].to_numpy()
    all_toxic, all_clean = sizes_of(labelled(labels, id_col, label_col))
    weights = np.where(kinds == 1, all_toxic / toxic, all_clean / clean)
    return Fit(shared, float(share), *calibrated(votes["vote"].to_numpy(), kinds, weights / weights.mean()), frequencies, number)


def nearest_examples(texts: DataFrame, shared: Broadcast, neighbours: int = NEIGHBOURS, others: bool = True) -> DataFrame:
    """(row, id, vote, square, evidence, others) of every row of ``texts`` (id, text).

    ``evidence`` has the nearest examples with the cosines of the text's known terms alone, whose
    squared length is ``square``; ``others`` are the text's other terms, which lengthen its vector
    and so change the size of its cosines, all by one factor, and neither their order nor the votes. They
    are null if not asked for.
    """
    id_type = dict(texts.dtypes)["id"]
    evidence_type = f"array<struct<id: {id_type}, cosine: double, toxic: int>>"

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value  # kept by the worker, with its index
        index = model.index
        row = TaskContext.get().partitionId() << 40
        for batch in (part for b in batches for part in slices(b, 1, _ROWS, _BYTES)):
            queries, squares, counted = [], [], Counted.of(batch.column(1), model.terms)
            for terms, counts in counted:
                weights = index.raw_weights(terms, counts)
                square = float((weights * weights).sum())
                queries.append((terms, weights / np.sqrt(square) if square else weights))
                squares.append(square)
            near = list(index.search(queries, neighbours))
            evidence = [[{"id": model.names[index.ids[r]], "cosine": float(c), "toxic": int(index.labels[r])} for r, c in zip(rows[:EVIDENCE], cosines)] for rows, cosines in near]
            columns = [
                pa.array(range(row, row + batch.num_rows), pa.int64()),
                batch.column(0),
                pa.array([model.vote(*found) for found in near], pa.float64()),
                pa.array(squares, pa.float64()),
                pa.array(evidence, pa.list_(pa.struct([("id", batch.column(0).type), ("cosine", pa.float64()), ("toxic", pa.int32())]))),
                pc.if_else(pa.array([others and len(found[0]) > 0 for found in near]), counted.others, None),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "vote", "square", "evidence", "others"])
            row += batch.num_rows

    return texts.select("id", "text").mapInArrow(searched, f"row long, id {id_type}, vote double, square double, evidence {evidence_type}, others array<struct<term: string, count: int>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_EXAMPLES, neighbours: int = NEIGHBOURS, cosines: bool = True) -> DataFrame:
    """(id, score, evidence array<struct<id, cosine, toxic>>) of every row of ``docs``.

    Without ``cosines`` the evidence has no cosine, and what a text's terms outside the examples add to
    its vector's length isn't looked up: that scales all its cosines alike, so neither their order
    nor a score depends on it.

    The model is fitted on up to ``most`` labelled rows and asks ``neighbours`` of them. Null and
    empty texts, and texts without any term of the examples, get the calibrated base rate and no
    evidence, and so do all if no label or only one kind of label is known. Repeated rows are
    scored alike; ties among examples go by their texts' hashes. Of the tables' other columns none is
    read; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = fit(texts, labels, id_col, label_col, most, neighbours)
    evidence_type = f"array<struct<id: {dict(texts.dtypes)['id']}, cosine: double, toxic: int>>"
    bare = F.transform("evidence", lambda x: x.dropFields("cosine"))
    if found.model is None:
        none = texts.select("id", found.score(F.lit(found.share)).alias("score"), F.array().cast(evidence_type).alias("evidence"))
        return none if cosines else none.withColumn("evidence", bare)
    near = nearest_examples(texts, found.model, neighbours, others=cosines)
    score = found.score(F.col("vote")).alias("score")
    if not cosines:
        return near.select("id", score, bare.alias("evidence"))
    near = materialise(near, "nearest-examples")
    # a term that isn't common is in few documents, so no key is hot
    others = near.select("row", F.explode("others").alias("o")).select("row", "o.term", "o.count").join(found.frequencies, "term")
    weight = (1 + F.log("count")) * F.log((1 + found.number) / (1 + F.col("n")))
    longer = others.groupBy("row").agg(F.sum(weight * weight).alias("more"))
    shrink = F.sqrt(F.col("square") / (F.col("square") + F.coalesce("more", F.lit(0.0))))
    evidence = F.transform("evidence", lambda x: x.withField("cosine", x["cosine"] * F.col("shrink")))
    whole = near.drop("others").join(longer, "row", "left").withColumn("shrink", shrink)
    return whole.select("id", score, evidence.alias("evidence"))
