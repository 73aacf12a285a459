"""Approximate nearest neighbours by collision-counting hashing (query-aware projections).

Vectors are projected on single lines. The index keeps, for each line, the vectors' projections in
sorted order, and each vector's place in it; there are no fixed buckets. A query puts a window around
its own projection on every line. A vector collides on a line if its place lies in the window, and
vectors that collide on at least ``THRESHOLD`` of the lines are verified by their exact inner product. If
a query has too few such candidates, all its windows are widened by a factor (virtual rehashing: as if
larger buckets had been used from the start) and the count is taken again.

The ``LINES`` lines, or a few more, are the axes of random rotations: orthogonal lines tell more apart than as many
independent ones, and wide windows with a high threshold more than narrow ones with a low threshold.

Inner products become distances by one more coordinate: with M the largest norm, x goes to
(x / M, sqrt(1 - |x|^2 / M^2)) and q to (q / |q|, 0), so that the largest inner product is the
smallest distance.

Every valid row is indexed, in blocks of about ``BLOCK_ROWS`` that a hash of the id fills, so the answer
does not depend on how the table is laid out. Each block has its own sorted lines and answers for
itself, and the best ``k`` over all blocks are kept, so blocks are independent tasks and nothing is
capped. Queries meet the blocks in blocks too (a stated query set against all rows), paired by the number of the block.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no
part, and neither do rows without an id. Vectors of different dimensions are never compared. Ties in
the score go to the smaller id. Rows that repeat an id are candidates one by one, but a query never
finds its own id; queries that repeat an id have their finds together. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines; collisions needed, as a share of the lines; rows that the first window is chosen by; factor of widening.
LINES = 195
THRESHOLD = 0.8
PROBED = 512
WIDEN = 1.03
#: A query is done with a block when this share of the block, and 8 k rows at least, are verified.
VERIFIED = 0.07
BLOCK_ROWS = 16_384
QUERY_ROWS = 1_024
SEED = 17


def valid(vec: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    x = F.transform(vec, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(x, lambda v: v != 0.0)


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows (id, vec array<double>) packed to (block int, ids binary, dim int, data binary), by a hash of the id; and how many
    blocks there are."""
    n = 1 + rows.count() // size
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartitionById(n, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(dim: int, block: int, parts: list) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((*data.T[::-1], ids))
            columns = [pa.array([block], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([data[order].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "dim", "data"])

        for batch in batches:
            vecs = batch.column("vec")
            ids, block, dims = batch.column("id").to_numpy(), batch.column("block").to_numpy(), vecs.value_lengths().to_numpy()
            for dim in np.unique(dims):
                for b in np.unique(block[dims == dim]):
                    mine = np.flatnonzero((dims == dim) & (block == b))
                    parts = held.setdefault((dim, b), [])
                    parts.append((ids[mine], vecs.take(pa.array(mine)).flatten().to_numpy().reshape(-1, dim)))
                    if sum(len(i) for i, _ in parts) >= 2 * size:  # rows of one id
                        yield out(dim, b, held.pop((dim, b)))
        for (dim, b), parts in sorted(held.items()):
            yield out(dim, b, parts)

    return dealt.mapInArrow(pack, "block int, ids binary, dim int, data binary"), n


def rotations(dim: int, seed: int = SEED) -> np.ndarray:
    """The axes of random rotations, as columns; whole rotations, ``LINES`` or a few more."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-LINES // dim))], axis=1)


class BlockIndex:
    """Sorted projections of one block of vectors, and the places of the vectors in them."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, top: float, lines: np.ndarray):
        self.ids, self.data = ids, data
        scaled = data / top
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        projected = (np.concatenate((scaled, rest[:, None]), axis=1) @ lines).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.place = np.empty(order.shape, np.uint16 if len(ids) < 1 << 15 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None], axis=1)
        some = np.random.default_rng(SEED).permutation(len(ids))[:PROBED]
        self.probed = np.ascontiguousarray(projected.T[some])

    def search(self, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query, given by its projections ``at`` [query, line], the rows that collide enough."""
        n, m = len(self.ids), len(self.sorted)
        need = min(n, max(8 * k, int(VERIFIED * n)))
        least = int(np.ceil(THRESHOLD * m))
        # the first half-width: a probed row collides enough from its least-th smallest distance on
        first = min(len(self.probed) - 1, int(len(self.probed) * need / n * 1.1))
        for own in at:
            enough = np.partition(np.abs(self.probed - own), least - 1, axis=1)[:, least - 1]
            width = np.partition(enough, first)[first] + 1e-12
            while True:
                left, right = self._places(own - width), self._places(own + width, "right")
                hits = np.flatnonzero(self._collisions(left, right) >= least)
                if len(hits) >= need or ((left == 0).all() and (right == n).all()):
                    yield hits
                    break
                width *= WIDEN

    def _places(self, values: np.ndarray, side: str = "left") -> np.ndarray:
        return np.array([line.searchsorted(v, side) for line, v in zip(self.sorted, values.tolist(), strict=True)])

    def _collisions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each row, the lines on which its place lies in the window from left to right."""
        kind, counts = self.place.dtype, np.zeros(len(self.ids), np.uint16)
        left, width = left.astype(kind)[:, None], (right - left).astype(kind)[:, None]
        for i in range(0, len(left), 32):
            # places below the window wrap around and come out far above it
            hit = (self.place[i : i + 32] - left[i : i + 32]) < width[i : i + 32]
            counts += hit.view(np.uint8).sum(axis=0, dtype=np.uint8)
        return counts


def search(base: DataFrame, queries: DataFrame, k: int, vec: str, vec_id: str, seed: int = SEED) -> DataFrame:
    """(query_id, rank, <vec_id>, score): each query's ``k`` nearest found by inner product.

    ``queries`` and ``base`` are rows with ``vec_id`` and ``vec``; a query is not its own neighbour.
    A query with fewer candidates than ``k`` gets them all.
    """
    columns = [F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.transform(F.col(f"`{vec}`"), lambda v: v.cast("double")).alias("vec")]
    fit = lambda df: df.filter(F.col(f"`{vec_id}`").isNotNull() & valid(F.col(f"`{vec}`"))).select(*columns)
    base_rows = fit(base)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    top = base_rows.agg(F.max(norm)).first()[0] or 1.0
    blocks, n = _blocks(base_rows, BLOCK_ROWS)
    asked, _ = _blocks(fit(queries), QUERY_ROWS)
    # each block of queries is sent to every block of rows, by the block's number; a block's rows come before its queries, so
    # its lines are sorted once
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("part"), "ids", "dim", "data")
    met = blocks.select("block", F.lit(0).alias("part"), "ids", "dim", "data").union(sent)
    met = met.repartitionById(n, "block").sortWithinPartitions("block", "part", "dim")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, indexes = None, {}
        for batch in batches:
            for block, part, ids, dim, data in batch.itertuples(index=False):
                if block != here:
                    here, indexes = block, {}
                rows, vecs = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)
                if part == 0:
                    indexes.setdefault(dim, []).append(BlockIndex(rows, vecs, top, rotations(dim + 1, seed)))
                    continue
                at = vecs / np.sqrt(np.einsum("ij,ij->i", vecs, vecs))[:, None] @ rotations(dim + 1, seed)[:-1]
                out = []
                for index in indexes.get(dim, ()):
                    for q, found in enumerate(index.search(at, k)):
                        found = found[index.ids[found] != rows[q]]
                        score = np.einsum("ij,j->i", index.data[found], vecs[q])
                        best = np.lexsort((index.ids[found], -score))[:k]
                        out.append((np.full(len(best), rows[q]), index.ids[found[best]], score[best]))
                if out:
                    q_id, v_id, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"query_id": q_id, "found": v_id, "score": score})

    near = met.mapInPandas(run, "query_id bigint, found bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("found").alias(vec_id), "score"
    )
