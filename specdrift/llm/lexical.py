"""Ranked lexical search with norm buckets.

A document's impact vector has a coordinate for each query term in it. Vectors are ordered by length over the whole
corpus and worked on in buckets of equal length nearly. With |q| |p| < the query's k-th best score so far a whole
bucket is out (Cauchy-Schwarz). Inside, the query's heaviest coordinates are multiplied out, the rest is
bounded by the rest of both lengths, and only vectors that may still be among the best are scored again,
in 64-bit integers over all terms. A term's weight is split evenly between query and document,
which changes no product and makes both lengths tell more. The bucket of the longest vectors goes first and gives
all others their first k-th scores.

Queries are taken in blocks of about ``block`` terms; what is sent to the tasks and collected is one block's terms and
weights, whatever the number of documents. Each block is a pass over the documents: texts are parsed once in it, vectors
of integers are kept and dealt by length, and of results each task hands on k for a query at most.

Defined results: null and empty texts have no terms and are found by nothing; documents without a doc_id count but are
never found; repeated documents are found one by one; items without an id are left out; rows that repeat an item id are one
item with the terms of all; an item without a term, or whose terms no document holds, gives no row; equal
scores rank by doc_id; empty tables give no rows; columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specdrift.llm.io import discard, stored
from specdrift.llm.terms import Terms, lists, spread
from specdrift.llm.textnum import U64, sliced

TOP = 10
#: Terms of the queries of a block, vectors of a bucket, coordinates multiplied out first.
BLOCK, BUCKET, FOCUS = 50_000, 2048, 8
#: Room for rounding in bounds; scores themselves are integers.
SLACK = 1 + 1e-9


class Queries(NamedTuple):
    """A block of queries over the block's sorted vocabulary."""

    names: list
    first: np.ndarray  # where each query's terms start
    terms: np.ndarray
    counts: np.ndarray
    weights: np.ndarray  # of the vocabulary
    docs: int  # with a term
    words: int  # of all documents


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK,
    bucket: int = BUCKET,
) -> DataFrame:
    """(item_id, rank int, doc_id bigint, score bigint): the ``top`` documents of each item with a score above 0."""
    kind = items.schema[item_id].dataType
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("body")).filter("item is not null")
    asked = stored(own.mapInArrow(_asked, "item string, term bigint, n bigint").groupBy("item", "term").agg(F.sum("n").alias("n")), "queries")
    blocks = max(1, math.ceil(asked.count() / block))
    named = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("string").alias("body"))
    found = [_found(named, asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i), top, bucket) for i in range(blocks)]
    best = reduce(DataFrame.union, found)
    return best.select(F.col("item").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "body"):
        t = Terms(batch.column("body"))
        of = np.repeat(np.arange(batch.num_rows), t.sizes)
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(of)), pa.array(t.hashes.view(np.int64)), pa.array(np.ones(len(of), np.int64))], names=["item", "term", "n"])


def _found(named: DataFrame, asked: DataFrame, top: int, bucket: int) -> DataFrame:
    """(item, rank, doc, score) of one block of queries."""
    spark = named.sparkSession
    rows = asked.toPandas()
    vocabulary, terms = np.unique(rows["term"].to_numpy(np.int64).view(U64), return_inverse=True)
    names, of = np.unique(rows["item"].to_numpy(str), return_inverse=True)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(names) + 1))
    vectors = stored(named.mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)), "doc bigint, n bigint, terms array<int>, tfs array<int>"), "vectors")
    n, words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), np.int64)
    for term, many in vectors.mapInArrow(_document_counts(len(vocabulary)), "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():
        held[term] = many
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
    queries = Queries(names.tolist(), first, terms[order], rows["n"].to_numpy(np.int64)[order], weights, n, words)
    queries = spark.sparkContext.broadcast(queries)

    sized = vectors.filter("doc is not null and size(terms) > 0").mapInArrow(_with_length(queries), "doc bigint, n bigint, terms array<int>, tfs array<int>, length double")
    # copies have one length: the id deals them, too
    dealt = sized.repartitionByRange(F.col("length").desc(), F.xxhash64("doc")).sortWithinPartitions(F.col("length").desc())
    buckets = stored(dealt.withColumn("bucket", F.spark_partition_id()), "buckets")
    discard(vectors)
    ddl = "item int, doc bigint, score bigint"
    start = np.ones(len(names), np.int64)
    longest = buckets.filter(F.col("bucket") == 0).mapInArrow(_best(queries, start, top, bucket), ddl)
    for item, score in _ranked(longest, top).filter(F.col("rank") == top).select("item", "score").collect():
        start[item] = score
    ranked = _ranked(buckets.mapInArrow(_best(queries, start, top, bucket), ddl), top)
    called = spark.createDataFrame(list(enumerate(names.tolist())), "item int, name string")  # as many as the block has
    return ranked.join(F.broadcast(called), "item").select(F.col("name").alias("item"), "rank", "doc", "score")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def _vectors(vocabulary) -> Callable:
    """Of each text its number of terms, and those of the vocabulary with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in sliced(batches, "body"):
            t = Terms(batch.column("body"))
            place = np.minimum(np.searchsorted(known, t.hashes), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[place] == t.hashes) if len(known) else np.empty(0, np.int64)
            of = np.searchsorted(t.first, hit, "right") - 1
            pair, tf = np.unique(of * max(len(known), 1) + place[hit], return_counts=True)
            of, term = np.divmod(pair, max(len(known), 1))
            counts = np.bincount(of, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(t.sizes.astype(np.int64)), *(lists(counts, pa.array(x.astype(np.int32))) for x in (term, tf))], names=["doc", "n", "terms", "tfs"]
            )

    return run


def _document_counts(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    return run


def _parts(batch: pa.RecordBatch, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each coordinate of a batch's vectors: its row, its term, and its integer impact without the term's weight."""
    size = np.asarray(batch.column("terms").value_lengths()).astype(np.int64)
    term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    n = batch.column("n").to_numpy()
    if len(n) and 75 * int(n.max()) * q.docs >= 1 << 63:
        m = np.array([25 + 75 * x * q.docs // q.words for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n * q.docs // max(q.words, 1)
    return np.repeat(np.arange(len(size)), size), term, 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))


def _with_length(queries) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, impact = _parts(batch, queries.value)
            squares = np.bincount(row, queries.value.weights[term] * impact.astype(float) ** 2, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(squares))], names=[*batch.schema.names, "length"])

    return run


class _Bucket:
    """Vectors by coordinate: for each term the rows that have it, and their integer and real values."""

    def __init__(self, batch: pa.RecordBatch, q: Queries):
        row, term, impact = _parts(batch, q)
        order = np.argsort(term, kind="stable")
        self.row, term, impact = row[order], term[order], impact[order]
        self.exact = impact * q.weights[term]
        self.real = impact * np.sqrt(q.weights[term])
        self.first = np.searchsorted(term, np.arange(len(q.weights) + 1))
        self.doc, self.length = batch.column("doc").to_numpy(), batch.column("length").to_numpy()

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all values of these terms, and how many each term has."""
        many = self.first[terms + 1] - self.first[terms]
        return spread(self.first[terms], many), many


def _best(queries, start: np.ndarray, top: int, bucket: int) -> Callable:
    """(item, doc, score): for each query the best ``top`` vectors of a task that score ``start`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        least, best = start.copy(), [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q.names]
        real = q.counts * np.sqrt(q.weights[q.terms])
        length = np.sqrt(np.add.reduceat(real**2, q.first[:-1])) if len(q.names) else np.empty(0)
        # each query's heaviest coordinates
        heavy = [q.first[i] + np.argsort(-real[q.first[i] : q.first[i + 1]], kind="stable")[:FOCUS] for i in range(len(q.names))]
        rest = [max(0.0, length[i] ** 2 - float((real[heavy[i]] ** 2).sum())) for i in range(len(q.names))]
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(-batch.column("length").to_numpy(), kind="stable")))
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                most = part.column("length")[0].as_py()
                alive = np.flatnonzero(length * most * SLACK >= least)
                if not len(alive):
                    break
                b = _Bucket(part, q)
                for i in alive.tolist():
                    scores, docs = _survivors(b, q, i, real, heavy[i], rest[i], least[i])
                    if not len(scores):
                        continue
                    scores, docs = np.concatenate((best[i][0], scores)), np.concatenate((best[i][1], docs))
                    order = np.lexsort((docs, -scores))[:top]
                    best[i] = scores[order], docs[order]
                    if len(order) == top:
                        least[i] = max(least[i], scores[order[-1]])
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), *(pa.array(np.concatenate([x[j] for x in best])) for j in (1, 0))], names=["item", "doc", "score"]
            )

    return run


def _survivors(b: _Bucket, q: Queries, i: int, real: np.ndarray, heavy: np.ndarray, rest: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores, of ``least`` or more, and doc_ids of the bucket's vectors that their bounds don't rule out."""
    n = len(b.doc)
    at, many = b.of(q.terms[heavy])
    got = np.bincount(b.row[at], b.real[at] * np.repeat(real[heavy], many), n)
    left = np.maximum(b.length**2 - np.bincount(b.row[at], b.real[at] ** 2, n), 0.0)
    # the rest of a length is a difference: what it is off by goes with the whole length
    bound = got + np.sqrt(rest * (left + 1e-9 * b.length**2))
    may = bound * SLACK >= least
    if not may.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mine = slice(q.first[i], q.first[i + 1])
    at, many = b.of(q.terms[mine])
    counts = np.repeat(q.counts[mine], many)
    hit = may[b.row[at]]
    score = np.zeros(n, np.int64)
    np.add.at(score, b.row[at[hit]], b.exact[at[hit]] * counts[hit])
    kept = np.flatnonzero(score >= least)
    return score[kept], b.doc[kept]
